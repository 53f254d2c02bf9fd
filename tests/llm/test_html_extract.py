"""Pages written by hand, hosts whose template must be deduced, and classes by brute force."""

import random
import tracemalloc

import pytest

from parleynet.llm import html_extract as H

BODY = "<article><h1>A &amp; B</h1><p>First&nbsp; para <b>bold</b> x<br>y</p><p>Second <i>para</i></article>"
CASES = [
    (None, ""), ("", ""), ("just text", "just text"), ("<p>unclosed <b>bold", "unclosed bold"), (f"<nav>menu</nav>{BODY}<footer>foot</footer>", "A & B\n\nFirst para bold x y\n\nSecond para"),
    ("<html><head><title>T</title><style>p{}</style></head><body><header>H</header><main><p>In</p><aside>side</aside><form>f</form><div class='post-comments'>c</div><div class=\"cookie-notice\">n</div><ins class=ad>buy</ins><p>Out</p></main></body>", "In\n\nOut"),
    ("<article><p>a<p>b<ul><li>c<li>d</ul>e</article>", "a\n\nb\n\nc\n\nd\n\ne"), ("<article><script>if (a < b) { document.write('<p>x</p>') }</script><p>ok</p><!-- <p>no</p> --></article>", "ok"),
    ("<article><p>1 &lt; 2 &#8212; &eacute; &unknown; &am</p></article>", "1 < 2 — é &unknown; &am"), ("<article><p>a < b and c > d</p></article>", "a < b and c > d"), ("<article><header><h1>Head</h1><span>By me</span></header><p>t</p></article>", "Head\n\nt"),
    ("<article><div class='article-header'><h1>Head</h1><p>By me</p></div><p>t</p></article>", "Head\n\nt"), ("<div class=page-header>Site</div><p>t</p>", "t"), ("<article><h1 class=entry-header>Head</h1></article>", "Head"),
    ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"), ('<article><p title="a > b">attr</p></article>', "attr"), ("<article><p>x</p><article class='comment'><p>reader</p></article></article>", "x"), ("<script>never closed <p>x</p>", ""), ("<article><p hidden>h</p><p>s</p></article>", "s"),
    ("<article><table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table></article>", "a b\n\nc"), ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
]


@pytest.mark.parametrize("page, text", CASES)
def test_single_pages(page, text):
    assert H.extract(page or "") == text


def test_unclosed_quotes_take_linear_time():
    assert "end" in H.extract('<a href="x' * 20000 + "> end")


def pages(n, host="h.example"):
    return [(i, f"http://{host}/{i}", f"<div><div class=x1><a href=/a>Home</a> <a href=/b>About us</a></div><div class=x2>Subscribe now to our letter</div><div class=x3><p>Text number {i} of its own</p><p>More {i * i} words</p></div></div>") for i in range(n)]


def test_template_of_a_host_is_left_out(spark):
    rows = pages(15) + [(100, "http://lone.example/1", pages(1)[0][2]), (101, None, "<p>no url</p>"), (102, "http://h.example/none", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS template", "3 AS text", "4 AS digest", "5 AS payload").repartition(4)
    got = {r.page_id: r for r in H.main_texts(df).collect()}
    assert len(got) == 18
    assert got[3].text == "Text number 3 of its own\n\nMore 9 words" and got[3].n_chars == len(got[3].text)
    assert got[100].text.startswith("Home About us")  # a single page has no template to compare with
    assert (got[101].text, got[102].text) == ("no url", "")


def test_payloads_beyond_the_bound_meet_pages_in_parts(spark, monkeypatch):
    df = spark.createDataFrame(pages(15) + pages(12, "other.example"), "page_id long, url string, html string")
    sent = sorted((r.url, r.text) for r in H.main_texts(df).collect())
    assert sent[0][1] == "Text number 0 of its own\n\nMore 0 words"
    monkeypatch.setattr(H, "SENT_BYTES", 0)
    assert sorted((r.url, r.text) for r in H.main_texts(df).collect()) == sent


def test_empty_and_repeated(spark):
    schema = "page_id long, url string, html string"
    assert H.main_texts(spark.createDataFrame([], schema)).count() == 0
    assert H.main_texts(spark.createDataFrame([(1, "http://a/", BODY)] * 2, schema)).count() == 2


def layouts(r, n, host):
    """Pages of two layouts without any telling tag or name: links, fixed notes and rotating lines around texts of their own."""
    word = lambda k: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(k))
    lines, out = [word(6) for _ in range(3)], []
    for i in range(n):
        own = [word(r.randrange(30, 60)) for _ in range(r.randrange(2, 6))]
        text = "".join(f"<p>{x}</p>" for x in own)
        top = "<div class=k1>" + "".join(f"<div><a href=/{x}>{x} page</a></div>" for x in "abc") + "</div>"
        if i % 2:
            page = f"{top}<div class=k2>{text}</div><div class=k3>All rights lie with nobody</div><div class=k4>{r.choice(lines)}</div>"
        else:
            page = f"{top}<div class=k5>Write to us, we like letters</div><div class=k6><div class=k7>{text}</div></div><div class=k3>All rights lie with nobody</div>"
        out.append((i, f"http://{host}/{i}", f"<html><body>{page}</body></html>", "\n\n".join(own)))
    return out


def test_classes_alone_find_the_text(spark):
    """With tag and word rules off."""
    r = random.Random(4)
    rows = layouts(r, 24, "two.example") + [(100 + i, u, h, t) for i, u, h, t in layouts(r, 5, "few.example")]
    got = {x.page_id: x.text for x in H.main_texts(spark.createDataFrame([x[:3] for x in rows], "page_id long, url string, html string").repartition(3), prior=H.NO_PRIOR).collect()}
    two = [got[i] == t for i, _, _, t in rows if i < 100]
    assert all(two), [got[i] for i, _, _, t in rows if i < 100 and got[i] != t][:2]
    for i, _, _, t in rows:
        assert t in got[i] and "letters" not in got[i] and "nobody" not in got[i] and "a page" not in got[i]


def brute_classes(htmls):
    """Tokens by the vector of their counts, and which of these classes are ordered on all pages."""
    seqs = []
    for page in htmls:
        seqs.append([node.path if kind == "tag" else H.text_token(node.slot, H.squeeze(raw)) for kind, node, raw in H.events(page) if kind == "tag" or (kind == "text" and not node.hidden and H.squeeze(raw))])
    vectors = {}
    for token in {t for s in seqs for t in s}:
        vectors.setdefault(tuple(s.count(token) for s in seqs), set()).add(token)
    classes = {frozenset(v): k for k, v in vectors.items() if len(v) > 1 and sum(x > 0 for x in k) > 1}

    def cycles(c):
        found = set()
        for s in seqs:
            own = [t for t in s if t in c]
            if own:
                k = len(own) // len(c)
                found.add(tuple(own[: len(c)]) if len(own) == k * len(c) and own == own[: len(c)] * k else None)
        return found

    ordered = {c for c in classes if len(cycles(c)) == 1 and None not in cycles(c)}
    return classes, ordered


def test_classes_against_brute_force(spark):
    r = random.Random(9)
    rows = layouts(r, 9, "two.example")
    one, two = "<i class=z1></i>", "<i class=z2></i>"
    swapped = [h.replace("<body>", "<body>" + 2 * (one + two if i % 3 else two + one)) for i, _, h, _ in rows]
    df = spark.createDataFrame([("h", h) for h in swapped], "host string, html string")
    tokens = H.tokens_of(df)
    classes = H.classes_of(tokens, 1, 2)
    got, of = {}, {}
    for x in classes.collect():
        got.setdefault(x["class"], set()).add(x.token)
        of[x.token] = x["class"]
    brute, ordered = brute_classes(swapped)
    assert {frozenset(c) for c in got.values()} == set(brute)
    valid = H.nested(df, classes)[0].collect()
    found = {frozenset(got[x["class"]]) for x in valid}
    assert found <= ordered and len(found) > 2
    # The tokens that change places between pages are of no valid class.
    moved = {node.path for kind, node, _ in H.events(swapped[0]) if kind == "tag" and node.tag == "i"}
    assert moved and not moved & {x.token for x in valid}


def test_a_class_that_straddles_a_slot_is_split():
    page = "<a class=p1></a><a class=q1></a><a class=p2></a><a class=q2></a>"
    paths = [node.path for kind, node, _ in H.events(page) if kind == "tag"]
    of = {paths[0]: 0, paths[2]: 0, paths[1]: 1, paths[3]: 1}
    checks, slots, _, _ = H.class_checks(page, of, [2, 2])
    assert {c: bad for c, bad, _ in checks} == {0: False, 1: False}
    assert slots[paths[0]] == slots[paths[2]] == slots[paths[3]] != slots[paths[1]]
    # Out of order on the page: p2 comes where p1 should.
    checks, _, _, _ = H.class_checks(page + "<a class=p2></a>", of, [2, 2])
    assert dict((c, bad) for c, bad, _ in checks)[0]


def test_deep_pages_take_memory_in_proportion():
    peaks = []
    for n in (5000, 10000):
        page = "<article>" + "<div>" * n + "deep" + "</div>" * n + "</article>"
        tracemalloc.start()
        H.page_tokens(page)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 3 * peaks[0] and peaks[1] < 1000 * len(page)


def test_all_names_of_an_element_tell_it_apart():
    one, two = ([n.path for k, n, _ in H.events(f'<div class="a b c d {x}">t</div>') if k == "tag"] for x in ("one", "two"))
    assert one != two
