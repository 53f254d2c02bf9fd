"""A store of records that a job changes as a whole: rows and progress become visible together, when all tasks have ended.

A task writes its rows as JSON Lines into a file that nothing names yet. The commit writes the
next manifest, which lists the store's files and its progress, beside the store and moves it
into place. A reader goes by the newest manifest, so it sees all of a job or nothing of it; a
task that fails removes its file, an aborted job those of its tasks, and `vacuum` what lost
executors left. One job writes to a store at a time.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "record_store"
MANIFESTS, DATA = "_manifests", "data"


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if re.match("[a-z0-9]+:", path) else f"file://{path}")


def manifest(path: str) -> dict:
    """The newest manifest: version, files, rows and progress; that of a store without rows before the first."""
    fs, root = _place(path)
    folder = f"{root}/{MANIFESTS}"
    names = [f.base_name for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if re.fullmatch(r"\d+\.json", f.base_name)]
    if not names:
        return {"version": 0, "files": [], "rows": 0, "progress": {}}
    with fs.open_input_stream(f"{folder}/{max(names)}") as f:
        return json.loads(f.read().decode())


class Written(WriterCommitMessage):
    def __init__(self, file: str | None, rows: int):
        self.file, self.rows = file, rows


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, progress: dict | None):
        self.path, self.overwrite, self.progress = path, overwrite, progress
        # One writer is sent to all tasks, so their files bear the job's name.
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _place(self.path)
        name, rows = f"{DATA}/{self.job}-{uuid.uuid4().hex}.jsonl", 0
        fs.create_dir(f"{root}/{DATA}", recursive=True)
        try:
            with fs.open_output_stream(f"{root}/{name}") as out:
                for batch in iterator:
                    rows += batch.num_rows
                    out.write("".join(json.dumps(r, ensure_ascii=False, default=str) + "\n" for r in batch.to_pylist()).encode())
        except BaseException:
            fs.delete_file(f"{root}/{name}")
            raise
        if not rows:
            fs.delete_file(f"{root}/{name}")
        return Written(name if rows else None, rows)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _place(self.path)
        before, done = manifest(self.path), [m for m in messages if m is not None]
        new = {
            "version": before["version"] + 1,
            "files": ([] if self.overwrite else before["files"]) + [m.file for m in done if m.file],
            "rows": (0 if self.overwrite else before["rows"]) + sum(m.rows for m in done),
            "progress": before["progress"] if self.progress is None else self.progress,
        }
        folder = f"{root}/{MANIFESTS}"
        fs.create_dir(folder, recursive=True)
        draft = f"{folder}/{uuid.uuid4().hex}.draft"
        with fs.open_output_stream(draft) as out:
            out.write(json.dumps(new).encode())
        fs.move(draft, f"{folder}/{new['version']:012d}.json")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _place(self.path)
        for m in messages:
            if m is not None and m.file:
                fs.delete_file(f"{root}/{m.file}")


class RecordStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> Writer:
        progress = self.options.get("progress")
        return Writer(self.options["path"], overwrite, None if progress is None else json.loads(progress))


def write_store(rows: DataFrame, path: str, progress: dict | None = None, fresh: bool = False) -> None:
    """Adds rows to the store, or with `fresh` replaces what it holds; with `progress`, that is its progress from then on."""
    spark = rows.sparkSession
    spark.dataSource.register(RecordStore)
    writer = rows.write.format(FORMAT).mode("overwrite" if fresh else "append").option("path", path)
    (writer if progress is None else writer.option("progress", json.dumps(progress))).save()


def read_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all committed jobs; none for a store that isn't there."""
    files = manifest(path)["files"]
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json([f"{path}/{f}" for f in files])


def progress(path: str) -> dict:
    return manifest(path)["progress"]


def jobs(path: str) -> list[str]:
    """The jobs whose files the newest manifest names, in the order of their commits; a job has as many files as it had tasks with rows."""
    return list(dict.fromkeys(f.rsplit("/", 1)[-1].split("-")[0] for f in manifest(path)["files"]))


def vacuum(path: str) -> int:
    """Removes files that the newest manifest doesn't name; not while a job writes."""
    fs, root = _place(path)
    kept = {f.rsplit("/", 1)[-1] for f in manifest(path)["files"]}
    gone = [f.path for f in fs.get_file_info(pafs.FileSelector(f"{root}/{DATA}", allow_not_found=True)) if f.base_name not in kept]
    for f in gone:
        fs.delete_file(f)
    return len(gone)
