"""License scans against windows in plain Python."""

import random
import re

from parleynet.llm import license_scan as L

SCHEMA = "doc_id long, text string"


def brute(text, percent=80):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    found = set()
    for name, notice in L.NOTICES:
        w = re.findall(r"[^\W_]+", notice.lower())
        all_ = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        wanted = set(all_)
        for i in range(len(runs)):
            if any(runs[i] == x for _, n in L.NOTICES for x in _runs(n)) and 100 * len(set(runs[i : i + len(all_)]) & wanted) >= percent * len(wanted):
                found.add((name, i))
    return found


def _runs(notice):
    w = re.findall(r"[^\W_]+", notice.lower())
    return [tuple(w[i : i + 3]) for i in range(len(w) - 2)]


def test_against_brute_force(spark):
    r = random.Random(3)
    rows = [(1, None), (2, ""), (3, "all rights"), (4, "ALL RIGHTS\nreserved"), (5, "the the the"), (6, "x " * 30000 + "Released under the MIT License." + " y" * 10)]
    for i in range(40):
        name, notice = r.choice(L.NOTICES)
        words = notice.split()
        for _ in range(r.randrange(3)):
            words[r.randrange(len(words))] = r.choice(["other", "License"])
        filler = [r.choice(["under", "the", "license", "a", "b"]) for _ in range(20)]
        rows.append((10 + i, " ".join(filler[:10] + words + filler[10:] + (words if i % 5 == 0 else []))))
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS w", "2 AS s", "3 AS start", "'x' AS template", "4 AS b").repartition(3)
    got = {}
    for x in L.scan(df).collect():
        got.setdefault(x.doc_id, set()).add((x.template, x.start))
    assert got == {i: f for i, t in rows if (f := brute(t))}


def test_query_lists_every_document(spark, tmp_path):
    spark.createDataFrame([(1, "Licensed under CC BY-NC 4.0. All rights reserved."), (2, None), (None, "x")], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.licenses, r.n_licenses, r.first_word) for r in L.op7_license_scan(spark, str(tmp_path)).collect()}
    assert got == {1: ("CC-BY-NC-4.0,all-rights-reserved", 2, 0), 2: ("", 0, -1), None: ("", 0, -1)}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert L.scan(none).count() == 0
    assert L.scan(spark.createDataFrame([(1, "a b c")], SCHEMA), notices=()).count() == 0
