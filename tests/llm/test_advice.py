
from collections import defaultdict

import pytest

from corpusloom.llm import html_wrapper, quality_crf, queries, warc

from .conftest import docs_frame


def by_status(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["status"]].append(r["page_id"])
    return {k: sorted(v, key=lambda i: -1 if i is None else i) for k, v in out.items()}


def test_warc_names_exactly_the_damaged_records(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>é{i}</p>") for i in range(3000)], "page_id long, url string, html string")
    a, b = warc.records(pages), warc.records(queries.damaged(pages))
    got = by_status(warc.findings(a, b).collect())
    lost = [i for i in range(3000) if i % 211 == 7]
    bad = [i for i in range(3000) if i % 97 == 5 and i % 211 != 7]
    after = [i for i in range(3000) if any(x // 1024 == i // 1024 and x < i for x in lost)]
    assert got["missing"] == lost and got["corrupt"] == bad
    assert got["moved"] == [i for i in after if i not in lost and i not in bad]
    assert len(got["intact"]) == 3000 - len(lost) - len(bad) - len(got["moved"]) and "extra" not in got
    leaves, counts = warc.audit(a, b)
    assert counts[-1] == leaves.count() == len(lost) + len(bad)  # the descent ends at the damaged records only


def test_warc_repeated_and_unnamed_records(spark):
    rows = [(5, "u", h) for h in "abcdefghijklmnopqrstuvwxyz"] + [(None, "n", "1"), (None, "n", "2"), (None, "n", "3"), (2000, "u", "z"), (-3, "u", "z")]
    schema = "page_id long, url string, html string"
    a = warc.records(spark.createDataFrame(rows, schema))
    b = warc.records(spark.createDataFrame([r for r in rows if r not in ((5, "u", "c"), (None, "n", "2"), (2000, "u", "z"))] + [(4000, "u", "new")], schema))
    got = by_status(warc.findings(a, b).collect())
    assert got["missing"] == [None, 5, 2000] and got["extra"] == [4000] and "corrupt" not in got
    assert sum(map(len, got.values())) == len(rows) + 1
    back = by_status(warc.findings(b, a).collect())
    assert back["extra"] == got["missing"] and back["missing"] == got["extra"] and "corrupt" not in back


@pytest.mark.parametrize("attrs", ['class="overflow-hidden"', 'class="layout no-sidebar"', 'class="has-sidebar"', 'class="post-with-comments"', 'class="social-feed"', 'style="overflow:hidden"', 'data-x="not hidden"', 'class="sidebar"'])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_layout_classes_keep_the_article(attrs, tag):
    page = f'<body><nav>Menu</nav><div {attrs}><{tag}><h1>Title</h1><p>Text</p><div class="share">Share</div></{tag}></div><div class="site-footer">Foot</div></body>'
    assert html_wrapper.main_text(page, None, None) == "Title\nText"
    if attrs != 'class="sidebar"' and "social" not in attrs:
        assert html_wrapper.main_text(f"<body><div {attrs}><p>Text</p></div></body>", None, None) == "Text"


def test_marked_blocks_still_go():
    kept = "<article><p>A long article text</p></article>"
    for part in ("<div hidden>x</div>", '<div aria-hidden="true">x</div>', '<div class="ad-slot">x</div>', '<div class="related"><article>a</article><article>b</article></div>', '<section id="comments"><article class="comment">x</article></section>', '<div class="left-sidebar">x</div>'):
        assert html_wrapper.main_text(f"<body>{part}<div>{kept}</div>{part}</body>", None, None) == "A long article text"
    feed = '<body><div class="social-feed"><article>a b</article><article>c d</article><article>e f</article></div></body>'
    assert html_wrapper.main_text(feed, None, None) == "a b\nc d\ne f"


def extracted(spark, pages):
    d = spark.createDataFrame([(i, "https://h.example/x", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in html_wrapper.extract(d).collect()}


MENU = "".join(f"<div>Menu entry {k} of this host</div>" for k in range(30))


def layout_a(i):
    return f"<body><div>{MENU}</div><div><p>Article number {i} says {'abcdefghijklmnopqrstuvwxyz'[i % 26] * 30}</p></div></body>"


def layout_b(i):
    return f"<body><table><tr><td>Another layout's fixed line</td></tr></table><section><p>Piece number {i} tells {'zyxwvutsrqponmlkjihgfedcba'[i % 26] * 200}</p></section></body>"


def test_templates_of_hosts_with_much_boilerplate(spark):
    got = extracted(spark, [layout_a(i) for i in range(9)])
    assert all(t.startswith(f"Article number {i}") and "Menu" not in t for i, t in got.items())


def test_templates_despite_empty_pages_and_of_every_layout(spark):
    pages = [layout_a(i) for i in range(8)] + [layout_b(i) for i in range(8)] + [None, "", " \n", "<html></html>", "<p>404</p>"]
    got = extracted(spark, pages)
    assert all(got[i].startswith(f"Article number {i}") for i in range(8)) and all(got[8 + i].startswith(f"Piece number {i}") for i in range(8))
    assert not any("Menu" in t or "fixed line" in t for t in got.values()) and [got[i] for i in range(16, 21)] == ["", "", "", "", "404"]


def test_articles_crawled_often_are_no_template(spark):
    got = extracted(spark, [layout_a(0)] * 6 + [layout_a(0).replace("</body>", f"<p>{k}</p></body>") for k in range(6)])
    assert all("Article number 0" in t for t in got.values())


def test_classifier_learns_from_all_lines(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_crf, "train", lambda docs, y: seen.append([len(x) for x in docs]) or (None, None))
    docs = docs_frame(spark, ["\n".join(f"line {k} of {i}" for k in range(50 + 10 * i)) for i in range(12)])
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    quality_crf.fit(docs, labels)
    learnt = [r["doc_id"] for r in labels.where(~quality_crf.held_out(labels["doc_id"])).collect()]
    assert seen == [[50 + 10 * i for i in sorted(learnt)]]
    monkeypatch.setattr(quality_crf, "TRAIN_LINES", 300)
    quality_crf.fit(docs, labels)
    assert 300 <= sum(seen[1]) < 300 + 160 and set(seen[1]) <= set(seen[0])  # whole documents only
