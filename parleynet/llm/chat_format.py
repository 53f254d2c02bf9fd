"""Chat formatting of reply trees.

Messages of a tree are joined with their parents by doubling: after k self-joins every
message knows its 2^k-th ancestor and the score gathered on the way, so a path of n
messages takes about log2(n) joins. Leaves climb to their roots along these jumps,
branches are ranked by the sum of their messages' scores, and each chosen path is
unfolded by the same jumps and formatted as one conversation.

A turn is written as ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a line break.
Control strings inside roles and texts are escaped by a backslash after their first
character and a backslash is doubled, so what is written can be read back exactly and
no text can open or close a turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._run import saved

OPEN, SEPARATOR, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that chat templates in public use take as control.
CONTROLS = (OPEN, SEPARATOR, CLOSE, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))
_ESCAPE = re.compile(r"\\(\\?)")
_TURN = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(SEPARATOR) + "(.*?)" + re.escape(CLOSE) + "\n", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def write_turns(turns: list[tuple[str, str]], trained: frozenset[str] = frozenset({"assistant"})) -> tuple[str, list[int]]:
    """(text, loss bounds): the bounds are start and end code points of each trained role's text, one after another."""
    parts, bounds, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{SEPARATOR}", escape(text)
        if role in trained:
            bounds += [at + len(head), at + len(head) + len(body)]
        parts += [head, body, CLOSE, "\n"]
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(parts), bounds


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation; anything else is refused."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"not a formatted conversation at {at}")
    return turns


def best_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, rank, total, steps, node) of the `top` best root-to-leaf paths of each tree.

    messages(tree, node, parent, score); steps counts upwards from the leaf. A parent
    that isn't in the tree, or the node itself, makes a root. Messages on or below a
    cycle have no root and so are on no path. Ties go to the smaller leaf.
    """
    nodes = saved(messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")))
    up = nodes.where("parent IS NOT NULL AND parent <> node").join(nodes.select("tree", F.col("node").alias("parent")), ["tree", "parent"], "left_semi")
    jump = saved(up.select("tree", "node", F.col("parent").alias("over"), F.col("score").alias("gained")))
    levels, reach = [], 1
    most = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    while jump.limit(1).count():
        levels.append(jump)
        if reach >= most:
            break  # only cycles go on
        second = jump.select("tree", F.col("node").alias("over"), F.col("over").alias("far"), F.col("gained").alias("more"))
        jump = saved(jump.join(second, ["tree", "over"]).select("tree", "node", F.col("far").alias("over"), (F.col("gained") + F.col("more")).alias("gained")))
        reach *= 2
    parents = up.select("tree", F.col("parent").alias("node")).distinct()
    climb = nodes.join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), F.col("node").alias("at"), F.lit(0.0).alias("total"))
    for level in reversed(levels):
        step = level.withColumnRenamed("node", "at")
        climb = climb.join(step, ["tree", "at"], "left").select("tree", "leaf", F.coalesce("over", "at").alias("at"), (F.col("total") + F.coalesce("gained", F.lit(0.0))).alias("total"))
    roots = nodes.join(up.select("tree", "node"), ["tree", "node"], "left_anti").select("tree", F.col("node").alias("at"), F.col("score").alias("own"))
    climb = climb.join(roots, ["tree", "at"]).select("tree", "leaf", (F.col("total") + F.col("own")).alias("total"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "leaf"))
    path = climb.withColumn("rank", rank).where(F.col("rank") <= top).select("tree", "leaf", "rank", "total", F.lit(0).alias("steps"), F.col("leaf").alias("node"))
    for k in range(len(levels) - 1, -1, -1):
        both = F.array(F.struct(F.col("steps"), F.col("node")), F.when(F.col("over").isNotNull(), F.struct((F.col("steps") + (1 << k)).alias("steps"), F.col("over").alias("node"))))
        path = path.join(levels[k], ["tree", "node"], "left").select("tree", "leaf", "rank", "total", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("s"))
        path = path.select("tree", "leaf", "rank", "total", "s.steps", "s.node")
    return path


def format_trees(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, rank, formatted, loss_bounds) of the `top` best paths of each tree.

    messages(tree, node, parent, role, text, score): tree and node name a message and are
    not null; a null role or text is empty, a null score 0. One conversation is one value
    and is put together in one place; nothing else is gathered.
    """
    schema = messages.select("tree", F.col("node").alias("leaf")).schema
    texts = messages.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    paths = best_paths(messages, top).join(texts, ["tree", "node"])
    chats = paths.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct("steps", "role", "text")), asc=False).alias("turns"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = [write_turns([(t["role"], t["text"]) for t in turns]) for turns in frame.pop("turns")]
            yield frame.assign(formatted=[x[0] for x in done], loss_bounds=[x[1] for x in done])

    kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
    return chats.mapInPandas(run, f"tree {kinds['tree']}, leaf {kinds['leaf']}, rank int, formatted string, loss_bounds array<int>")


def from_turns(rows: DataFrame, conv: str | Column, turn: str | Column, role: str | Column = "role", text: str | Column = "text") -> DataFrame:
    """Messages of linear conversations: each row replies to the one before by turn (null turns first; equal turns by role, then text).

    The tree is the conversation id as text; rows of a null id are one conversation, of the key `null`.
    """
    by = [F.col(c) if isinstance(c, str) else c for c in (conv, turn, role, text)]
    rows = rows.select(F.coalesce(by[0].cast("string"), F.lit("null")).alias("tree"), by[1].alias("turn"), by[2].alias("role"), by[3].alias("text"))
    node = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text"))
    rows = rows.withColumn("node", node)
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say: turn counts and digests of turns and of text under the loss mask."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for tree, text, bounds in zip(frame["tree"], frame["formatted"], frame["loss_bounds"]):
                turns = read_turns(text)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                loss = "".join(unescape(text[a:b]) for a, b in zip(bounds[::2], bounds[1::2]))
                out.append((tree, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(out, columns=["tree", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("tree", "formatted", "loss_bounds").mapInPandas(run, "tree string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    back = read_back(format_trees(from_turns(rows.unionByName(extra), "conv_id", "turn")))
    return back.select(F.col("tree").try_cast("long").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def _escaped_length(text: str) -> str:
    """SQL of the length that a text has once escaped: a character more for each backslash and each control string."""
    strings = ["\\", *CONTROLS]
    return f"length({text}) + " + " + ".join(f"(length({text}) - length(replace({text}, '{c}', ''))) // {len(c)}" for c in strings)


ORACLE = f"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]', 'user', 'x' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', 'x')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(OPEN) + len(SEPARATOR) + len(CLOSE) + 1} + {_escaped_length("role")} + {_escaped_length("text")}) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
