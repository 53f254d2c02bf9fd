"""Copies of an article on one host are no template."""

from parleynet.llm import html_extract as H

SCHEMA = "page_id long, url string, html string"


def test_copies_keep_their_text(spark):
    copy = "<nav>menu</nav><a href='/?session={0}'>Top</a><article><h1>Head</h1><p>The whole story.</p></article>"
    other = "<nav>menu</nav><a href='/?session={0}'>Top</a><article><h1>Other {0}</h1><p>Story {0}.</p></article>"
    rows = [(i, f"http://m.example/a?s={i}", copy.format(i)) for i in range(20)] + [(100 + i, f"http://m.example/{i}", other.format(i)) for i in range(3)]
    got = {r.page_id: r.text for r in H.main_texts(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert all(got[i] == "Head\n\nThe whole story." for i in range(20))
    assert got[101] == "Other 1\n\nStory 1."


def test_near_copies_of_a_marked_article_keep_their_text(spark):
    near = "<div>Visitor {0}</div><article><h1>Head</h1><p>The whole story.</p></article>"
    rows = [(i, f"http://n.example/{i}", near.format(i)) for i in range(20)]
    assert {r.text for r in H.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()} == {"Head\n\nThe whole story."}


def test_copies_without_a_marked_article_keep_their_text(spark):
    rows = [(i, f"http://c.example/{i}", f"<div><a href='/?s={i}'>Top</a></div><p>The whole story.</p><p>Its end.</p>") for i in range(20)]
    assert {r.text for r in H.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()} == {"Top\n\nThe whole story.\n\nIts end."}


def test_near_copies_with_the_varying_part_inside_the_marked_article(spark):
    near = "<nav>menu</nav><main><div>Visitor {0}</div><p>The whole story of one long day.</p></main>"
    rows = [(i, f"http://v.example/{i}", near.format(i)) for i in range(20)]
    got = {r.page_id: r.text for r in H.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: f"Visitor {i}\n\nThe whole story of one long day." for i in range(20)}


def test_one_of_two_texts_on_each_page(spark):
    texts = ["The river rose again on Monday and took the old bridge.", "A new school opens in the valley after ten years of talks."]
    for kind, (low, high) in {"m": ("<article>", "</article>"), "u": ("<div>", "</div>")}.items():
        rows = [(i, f"http://{kind}.example/{i}", f"<title>t</title><div>Visitor {i}</div>{low}<p>{texts[i % 2]}</p>{high}") for i in range(12)]
        for r in H.main_texts(spark.createDataFrame(rows, SCHEMA)).collect():
            assert texts[r.page_id % 2] in r.text and (kind == "u" or r.text == texts[r.page_id % 2])


def test_one_class_word_takes_no_unmarked_article_away():
    page = "<div class='post social'><p>Real article, with much more to say than what stands beside it.</p></div><div class='x'><p>other</p></div>"
    assert H.extract(page) == "Real article, with much more to say than what stands beside it.\n\nother"
    assert H.extract("<div class='social'><p>share</p></div><div><p>The story itself.</p></div>") == "The story itself."
