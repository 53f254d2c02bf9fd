"""Reply trees against brute-force walks; escaping and the loss mask."""

import hashlib
import random

from hypothesis import given, settings, strategies as st

from parleynet.llm import chat_format as C

SCHEMA = "tree string, node long, parent long, role string, text string, score double"
NASTY = st.text(alphabet="ab\\<|>/[]sINTendim_ \n", max_size=25) | st.sampled_from([*C.CONTROLS, "\\", "<\\s>", "\\\\<s>", "<|im_end|"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "tool"]) | NASTY, NASTY), max_size=6))
def test_turns_read_back(turns):
    text, bounds = C.write_turns(turns)
    assert C.read_turns(text) == turns
    assert [C.unescape(text[a:b]) for a, b in zip(bounds[::2], bounds[1::2])] == [t for r, t in turns if r == "assistant"]
    assert not any(c in C.escape(t) for _, t in turns for c in C.CONTROLS)


def brute(messages, top):
    out = {}
    trees = {}
    for tree, node, parent, role, text, score in messages:
        trees.setdefault(tree, {})[node] = (parent, role, text, score)
    for tree, nodes in trees.items():
        parents = {p for n, (p, *_) in nodes.items() if p is not None and p != n and p in nodes}
        paths = []
        for leaf in sorted(set(nodes) - parents):
            path, at, seen = [], leaf, set()
            while at is not None and at not in seen:
                seen.add(at)
                path.append(at)
                p = nodes[at][0]
                at = p if p in nodes and p != at else None
            if at is None:
                paths.append((-sum(nodes[n][3] or 0 for n in path), leaf, path[::-1]))
        for rank, (_, leaf, path) in enumerate(sorted(paths)[:top], 1):
            out[tree, rank] = (leaf, [(nodes[n][1] or "", nodes[n][2] or "") for n in path])
    return out


def test_trees(spark):
    r = random.Random(6)
    rows = []
    for t in range(12):
        for n in range(r.randrange(1, 30)):
            parent = r.choice([None, *range(n), *range(n)]) if n else None
            rows.append((f"t{t}", n, parent, r.choice(["user", "assistant", None]), r.choice(["x", "</s>", None, "long " * 9]), float(r.randrange(5)) if r.random() < 0.9 else None))
    rows += [("chain", n, n - 1 if n else None, "user", str(n), 1.0) for n in range(70)]
    rows += [("cycle", 1, 2, "user", "a", 1.0), ("cycle", 2, 1, "user", "b", 1.0), ("cycle", 3, 1, "user", "c", 1.0), ("self", 1, 1, "user", "a", 1.0), ("lost", 5, 99, "user", "a", 1.0)]
    r.shuffle(rows)
    for top in (1, 3):
        got = {(x.tree, x.rank): (x.leaf, C.read_turns(x.formatted)) for x in C.format_trees(spark.createDataFrame(rows, SCHEMA), top).collect()}
        assert got == brute(rows, top)


def test_query(spark, tmp_path):
    rows = [(1, 1, "assistant", "two\\"), (1, 0, "user", None), (2, 5, None, "<s>"), (3, None, "user", "n"), (3, 1, "user", "a"), (3, 1, "user", "a"), (None, 1, "user", "x"), (4, 0, "assistant", "é" * 5000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS node", "2 AS tree").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in C.op1_chat_format(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3, 4, None, -7}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == digest("user\n\nassistant\ntwo\\\n") and got[1].loss_chars == 4 and got[1].loss_sha256 == digest("two\\")
    assert (got[2].n_turns, got[3].n_turns, got[4].loss_chars, got[-7].loss_chars) == (1, 3, 5000, 21)
    assert got[-7].loss_sha256 == digest("</s>[INST] ok [/INST]")


def test_empty_table(spark):
    assert C.format_trees(spark.createDataFrame([], SCHEMA)).count() == 0
