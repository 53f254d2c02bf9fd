"""Queries that take whole texts, where a prefix would give less."""

from parleynet.plans import text_queries as Q

SCHEMA = "doc_id long, text string"


def documents(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_normal_forms_of_whole_texts(spark, tmp_path):
    d = documents(spark, tmp_path, [(1, "Ab-c " * 100), (2, "x" * 200 + "Y"), (3, "x" * 200 + "Z"), (4, None)])
    got = {r.doc_id: r for r in Q.QUERIES["normal_forms"](spark, d).collect()}
    assert (got[1].n_chars, got[2].n_chars, got[4].n_chars) == (399, 201, None)
    assert got[2].normal_md5 != got[3].normal_md5


def test_mentions_beyond_the_third_word(spark, tmp_path):
    d = documents(spark, tmp_path, [(1, "x y z the The der"), (2, "a the\tof\nvon"), (3, None), (4, "")])
    got = {r.mention: (r.n, r.actor) for r in Q.QUERIES["resolve_mentions"](spark, d).collect()}
    assert got["the"] == (2, "The") and got["The"] == (1, "The") and got["von"] == (1, "Of") and got["a"] == (1, None)
    assert sum(n for n, _ in got.values()) == 10


def test_groups_hold_rare_names(spark, tmp_path):
    rows = [(i, f"x Na{chr(97 + i // 26)}{chr(97 + i % 26)} y Na{chr(97 + i // 26)}{chr(97 + i % 26)}") for i in range(300)] + [(400, "x The House")]
    got = {r.surface: (r.canon, r["count"]) for r in Q.QUERIES["name_groups"](spark, documents(spark, tmp_path, rows)).collect()}
    assert len(got) == 301 and got["The House"] == ("The", 1) and got["Naaa"][1] == 2
