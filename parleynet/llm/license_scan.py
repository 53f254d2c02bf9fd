"""License scans by MinHash bands over overlapping text windows, in DataFrame operations only.

Texts and templates are sequences of lower-case words and sets of three-word shingles.
Windows as long as each template overlap at every word; a window's MinHash bands look up
templates of the same length, and what they retrieve is verified by exact containment of
the template's shingles in the window. A window that doesn't begin with a shingle of some
template needn't be signed: shifted to its first such shingle it holds the same ones.

With 20 bands of 2 rows, a window holding 0.8 of a template's shingles (Jaccard similarity
of at least 2/3, as both have the same length) is missed with probability
(1 - (2/3)^2)^20, under 1e-5, and an exact copy is never missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Notices by which public licences are named or granted.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("BSD-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "All rights reserved."),
)
WORD = r"[\p{L}\p{N}]+"
SHINGLE, BANDS, ROWS = 3, 20, 2


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def once(value: Column, use) -> Column:
    """use(value), with value computed once a row: as a lambda's variable it can't be copied into inner loops."""
    return F.get(F.transform(F.array(value), use), 0)


def shingle_hashes(w: Column) -> Column:
    """Hashes of the runs of SHINGLE words at each word; none where the text is shorter."""

    def of(w: Column) -> Column:
        n = F.size(w) - (SHINGLE - 1)
        at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(SHINGLE))))

    return once(w, of)


def bands(shingles: Column) -> Column:
    """One hash for each band of ROWS minima of the shingles under seeded permutations."""

    def least(s: Column, k: int) -> Column:
        return F.array_min(F.transform(s, lambda x: F.xxhash64(x, F.lit(k))))

    return once(shingles, lambda s: F.array(*(F.xxhash64(F.lit(b), *(least(s, b * ROWS + r) for r in range(ROWS))) for b in range(BANDS))))


def templates(spark: SparkSession, notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """(template, length, shingles): shingle count and distinct shingle hashes of each notice of SHINGLE words or more."""
    rows = spark.createDataFrame(list(notices), "template string, notice string").withColumn("all", shingle_hashes(words(F.col("notice"))))
    return rows.where(F.size("all") > 0).select("template", F.size("all").alias("length"), F.array_distinct("all").alias("shingles"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: tuple[tuple[str, str], ...] = NOTICES, percent: int = 80) -> DataFrame:
    """(doc_id, template, start, words, shared, shingles): every window verified to hold `percent` of a template's shingles.

    start is the window's first word and words its length; a text may hold many. A null
    text, or one of fewer than SHINGLE words, holds nothing. Templates are a parameter
    (a few hundred short notices), so they and their hashes are small enough to send along.
    """
    spark = docs.sparkSession
    known = templates(spark, notices).collect()
    if not known:
        return spark.createDataFrame([], "doc_id long, template string, start int, words int, shared int, shingles int")
    firsts = sorted({h for t in known for h in t.shingles})
    lengths = sorted({t.length for t in known})
    small = spark.createDataFrame(known, "template string, length int, shingles array<bigint>")


    def windows_of(s: Column) -> Column:
        """(start, rest) where a window may begin: the shingles from there, as many as the longest template has."""
        starts = F.filter(F.transform(s, lambda h, i: F.when(h.isin(firsts), i)), lambda i: i.isNotNull())
        return F.transform(starts, lambda i: F.struct(i.alias("start"), F.slice(s, i + 1, F.lit(lengths[-1])).alias("rest")))

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.explode(once(shingle_hashes(words(text)), windows_of)).alias("x"))
    windows = rows.select("doc_id", "x.start", "x.rest", F.explode(F.array(*map(F.lit, lengths))).alias("length"))
    windows = windows.select("doc_id", "start", "length", F.array_distinct(F.slice("rest", F.lit(1), F.col("length"))).alias("window"))
    signed = windows.withColumn("b", F.explode(F.array_distinct(bands(F.col("window")))))
    wanted = small.select("template", "length", F.col("shingles").alias("t"), F.explode(bands(F.col("shingles"))).alias("b"))
    found = signed.join(F.broadcast(wanted), ["length", "b"]).select("doc_id", "start", "template", "length", F.size(F.array_intersect("window", "t")).alias("shared"), F.size("t").alias("shingles"))
    found = found.where(F.col("shared") * 100 >= F.col("shingles") * percent)
    return found.select("doc_id", "template", "start", (F.col("length") + (SHINGLE - 1)).alias("words"), "shared", "shingles").distinct()


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    """Per document: the licences found, their number, and the first word of the first match (-1 without one)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs).groupBy("doc_id").agg(F.array_sort(F.collect_set("template")).alias("t"), F.min("start").alias("first"))
    out = docs.select("doc_id").join(found, "doc_id", "left")
    return out.select("doc_id", F.coalesce(F.concat_ws(",", "t"), F.lit("")).alias("licenses"), F.coalesce(F.size("t"), F.lit(0)).cast("long").alias("n_licenses"), F.coalesce(F.col("first"), F.lit(-1)).cast("long").alias("first_word"))


ORACLE = rf"""
WITH notices(template, notice) AS (VALUES {", ".join(f"('{name}', '{text}')" for name, text in NOTICES)}),
tw AS (SELECT template, regexp_extract_all(lower(notice), '{WORD}') AS w FROM notices),
ts AS (SELECT DISTINCT template, len(w) - 2 AS length, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT template, w, unnest(range(1, len(w) - 1)) AS i FROM tw)),
tn AS (SELECT template, count(*) AS n FROM ts GROUP BY template),
dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS w FROM documents),
ds AS (SELECT doc_id, i - 1 AS pos, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM dw)),
hits AS (SELECT doc_id, pos, template, length, ds.s FROM ds JOIN ts ON ds.s = ts.s),
starts AS (SELECT DISTINCT doc_id, pos, length AS l FROM (SELECT DISTINCT doc_id, pos FROM hits), (SELECT DISTINCT length FROM ts)),
windows AS (SELECT a.doc_id, a.pos, h.template, count(DISTINCT h.s) AS shared FROM starts a JOIN hits h ON h.doc_id = a.doc_id AND h.length = a.l AND h.pos >= a.pos AND h.pos < a.pos + a.l GROUP BY ALL),
ok AS (SELECT doc_id, w.template, pos FROM windows w JOIN tn ON w.template = tn.template WHERE shared * 100 >= n * 80),
found AS (SELECT doc_id, string_agg(DISTINCT template, ',' ORDER BY template) AS licenses, count(DISTINCT template) AS n, min(pos) AS first FROM ok GROUP BY doc_id)
SELECT d.doc_id, coalesce(licenses, '') AS licenses, coalesce(n, 0) AS n_licenses, coalesce(first, -1) AS first_word FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id
"""
