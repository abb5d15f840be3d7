"""Mixing, packing, search, chats, pages and archives against plain versions of themselves."""

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusloom.llm import chat_format, dom, exact_topk, html_wrapper, mixing, packing, queries, warc
from corpusloom.session import table

from .conftest import DATA, EDGES, docs_frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, stopped = 1.5 * sum(sizes.values()), {}
    while True:
        live = [s for s in names if s not in stopped]
        rest = budget - sum(stopped.values())
        t = {s: rest * w[s] / sum(w[x] for x in live) for s in live}
        over = [s for s in live if t[s] > 2 * sizes[s]]
        if not over:
            return t | stopped
        stopped |= {s: 2.0 * sizes[s] for s in over}


def test_mixing(spark, rng):
    texts = [t if len(t or "") < 999 else "w " * 60 for t in EDGES] + ["w " * rng.randrange(1, 60) for _ in range(300)]
    docs = docs_frame(spark, texts).withColumn("size", F.lit("x"))
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 2 == 0, "hot").otherwise(F.col("source")))
    rows = mixing.mix(docs).collect()
    size = {i: len(WORD.findall(t or "")) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["size"] for r in rows} == size
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    want = plain_targets({s: sum(r["size"] for r in x) for s, x in by.items()})
    for s, x in by.items():
        assert all(r["source_size"] == sum(q["size"] for q in x) and r["target"] == pytest.approx(want[s]) for r in x)
        assert all(r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0) for r in x)
        assert abs(sum(r["taken"] for r in x) - want[s]) <= 1
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}
    mixed = mixing.mixed(docs)
    times = defaultdict(int)
    for r in mixed.collect():
        times[r["doc_id"]] += 1
    assert mixed.columns == docs.columns
    assert dict(times) == {r["doc_id"]: r["taken"] // r["size"] for r in rows if r["taken"]}


def test_mixing_edges(spark):
    assert mixing.mix(docs_frame(spark, EDGES).limit(0)).count() == 0
    r = mixing.mix(docs_frame(spark, ["", None])).collect()
    assert [(x["size"], x["target"], x["taken"]) for x in r] == [(0, 0.0, 0)] * 2
    twice = docs_frame(spark, ["a b c"] * 4).withColumn("doc_id", F.lit(1).cast("long")).withColumn("source", F.lit("s"))
    assert mixing.mix(twice).agg(F.sum("taken")).first()[0] == 18
    assert mixing.mixed(twice).count() == 6


def test_subset_sums(rng):
    for _ in range(200):
        n = np.array(sorted(rng.sample(range(1, 50), rng.randrange(1, 8))))
        c = np.array([rng.randrange(1, 6) for _ in n])
        goal = rng.randrange(0, int((n * c).sum()) + 1)
        take = mixing.subset(n, c, goal)
        assert (take >= 0).all() and (take <= c).all()
        sums = {0}
        for a, b in zip(n, c, strict=True):
            sums = {s + k * int(a) for s in sums for k in range(b + 1)}
        assert abs(int((n * take).sum()) - goal) == min(abs(s - goal) for s in sums)


def test_pack_counts(rng):
    for _ in range(200):
        counts = {rng.randint(1, 60): rng.randint(1, 30) for _ in range(rng.randint(1, 30))}
        placed, bins = packing.pack_counts(counts, (16, 32, 64))
        caps = {b: c for first, n, c in bins for b in range(first, first + n)}
        fill = defaultdict(int)
        for size, _, first, n, each, used in placed:
            for b in range(first, first + n):
                assert fill[b] == used
                fill[b] += size * each
        for s, n in counts.items():
            spans = sorted((r, r + n_ * e) for z, r, _, n_, e, _ in placed if z == s)
            assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert set(fill) == set(caps)
        assert all(fill[b] <= caps[b] and all(k < fill[b] for k in (16, 32, 64) if k < caps[b]) for b in caps)
    # best fit: the piece of 10 goes where it leaves no room
    placed, bins = packing.pack_counts({54: 1, 50: 1, 10: 1}, (64,))
    assert sorted(b for z, _, b, *_ in placed if z == 10) == [0] and len(bins) == 2


def test_packing(spark, rng):
    texts = EDGES + ["w " * rng.randrange(1, 1500) for _ in range(80)] + ["z " * 70] * 50
    docs = docs_frame(spark, texts, extra=True)
    rows = packing.pack(docs).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        if r["bin_id"] is not None:
            by_bin[r["bin_id"]].append(r)
    for i, t in enumerate(texts):
        p = sorted(by_doc[i], key=lambda r: r["piece"])
        assert sum(r["n_words"] for r in p) == len(WORD.findall(t or ""))
        assert [r["first_word"] for r in p] == [sum(q["n_words"] for q in p[:k]) for k in range(len(p))]
        assert all((r["bin_id"] is None) == (r["n_words"] == 0) for r in p)
    for p in by_bin.values():
        p.sort(key=lambda r: r["bin_offset"])
        assert [r["bin_offset"] for r in p] == [sum(q["n_words"] for q in p[:k]) for k in range(len(p))]
        used = sum(r["n_words"] for r in p)
        assert {r["bin_capacity"] for r in p} == {next(c for c in packing.CAPACITIES if c >= used)}
    assert packing.pack(docs.limit(0)).count() == 0


def plain_top(vectors, k=10):
    v = {i: [math.floor(1024 * x) for x in e] for i, e in vectors if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    out = set()
    for q in v:
        if q % 100 == 0:
            s = sorted(((-sum(a * b for a, b in zip(v[q], e)), i) for i, e in v.items() if i != q))[:k]
            out |= {(q, r, i, -x) for r, (x, i) in enumerate(s, 1)}
    return out


def test_exact_topk(spark, monkeypatch):
    gen = np.random.default_rng(0)
    base = gen.normal(size=(450, 8)) * gen.gamma(1.0, 2.0, size=(450, 1))
    base[300:] = base[7]  # ties
    rows = [(i, [float(np.float32(x)) for x in e]) for i, e in enumerate(base)]
    rows += [(900, None), (1000, [None] * 8), (1100, [float("nan")] * 8), (1200, [1.0]), (1300, []), (None, [1.0] * 8)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    monkeypatch.setattr(exact_topk, "BLOCK", 64)
    monkeypatch.setattr(exact_topk, "RANGE", 100)
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in exact_topk.top_k(d).collect()}
    assert got == plain_top(rows)
    assert exact_topk.top_k(d.limit(0)).count() == 0
    few = spark.createDataFrame(rows[100:104], d.select("vec_id", "embedding").schema)
    assert exact_topk.top_k(few).count() == 3


def test_exact_scores_of_large_numbers():
    q, c = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 3.0]])
    assert exact_topk.exact_dots(q, c)[0, 0] == 2**60 + 3


def test_chat_round_trip(rng):
    parts = chat_format.CONTROL + ["\\", "\\-", "<", "[", "a", "é", "\n", "<<s>", "[/INS", "T]"]
    for _ in range(2000):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", "[TEXT]"]), "".join(rng.choice(parts) for _ in range(rng.randrange(6)))) for _ in range(rng.randrange(5))]
        segs = chat_format.segments(turns)
        text = "".join(t for t, _ in segs)
        assert chat_format.read_back(text) == turns
        assert [chat_format.unescape(t) for t, loss in segs if loss] == [t for r, t in turns if r == "assistant"]


def test_chat_format(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (2, 0, "assistant", "x"), (3, 0, "system", "s"), (None, 0, "user", "n"), (4, 0, "user", "a"), (4, 0, "user", "a"), (5, 0, None, "</s>")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("valid", F.lit("x"))
    out = {r["conv_id"]: r for r in chat_format.format_conversations(d).collect()}
    assert out[1]["formatted"] == "[INST][/INST]<s>b</s>" and out[1]["valid"] and out[None]["valid"]
    assert [out[i]["valid"] for i in (2, 3, 4, 5)] == [False] * 4 and out[2]["error"] == "turn 0: assistant after start"
    dig = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_conversations(d)).collect()}
    assert dig[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\nb\n").hexdigest()
    assert (dig[1]["n_turns"], dig[1]["loss_chars"], dig[1]["loss_sha256"]) == (2, 1, hashlib.sha256(b"b").hexdigest())
    assert dig[5]["turns_sha256"] == hashlib.sha256(b"\n</s>\n").hexdigest() and dig[4]["n_turns"] == 2
    assert chat_format.format_conversations(d.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head><body class="has-sidebar">
<header><div class="logo">Logo</div></header><nav><ul><li><a href="/">Home {i}</a></ul></nav><div class="cookie-notice">We use {i}</div><aside>Side {i}</aside>
<main><h1>Title {i}</h1><div class="share">Share</div><p>First &amp; <b>bold<br>line
 two</p><p>Second<p>Third {i}<ul><li>x<li>y</ul><p class="tag">Fixed line</p><form><input>Send</form><section id="comments"><article class="comment"><p>Nice {i}</p></article></section></main>
<footer>&copy; {i}</footer></body></html>"""


def test_main_text():
    want = "Title 1\nFirst & bold line two\nSecond\nThird 1\nx\ny\nFixed line"
    assert html_wrapper.main_text(PAGE.replace("{i}", "1"), None, None) == want
    assert html_wrapper.main_text(PAGE.replace("{i}", "1").split("Second")[0], None, None).startswith("Title 1\nFirst & bold line two")
    assert html_wrapper.main_text("", None, None) == html_wrapper.main_text("<", None, None)[:0] == ""
    assert html_wrapper.main_text("<p>a &lt;b&gt; c &#233;", None, None) == "a <b> c é"
    assert html_wrapper.main_text("a < b<p>x", None, None) == "a < b\nx"


def test_tree_matching():
    a, b = dom.parse("<body><p>x</p><div><p>y</p></div><p>z</p></body>"), dom.parse("<body><p>x</p><div><p>w</p><p>y</p></div></body>")
    pairs = html_wrapper.align(a, html_wrapper.freeze(b))
    assert [(n.text, same) for n, _, same in pairs if n.text == "x"] == [("x", True)] and len(pairs) == 2


def test_html_wrapper(spark):
    rows = [(i, f"https://h.example/{i}", PAGE.replace("{i}", f"number {i} " + "text " * 40)) for i in range(8)]
    rows += [(20, "https://h.example/20", rows[3][2]), (21, None, "<p>solo</p>"), (22, "https://other/", None), (23, "x", "")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n_chars", F.lit("x"))
    got = {r["page_id"]: r["text"] for r in html_wrapper.extract(d).collect()}
    assert "Fixed line" not in got[0] and "Second" not in got[0]  # constant nodes are template
    assert got[0].startswith("Title number 0") and "Third number 0" in got[0] and "Nice" not in got[0] and got[20] == got[3]
    assert (got[21], got[22], got[23]) == ("solo", "", "")
    assert html_wrapper.extract(d.limit(0)).count() == 0
    copies = spark.createDataFrame([(i, "https://c.example/a", PAGE.replace("{i}", "same")) for i in range(9)], "page_id long, url string, html string")
    assert {r["text"] for r in html_wrapper.extract(copies).collect()} == {html_wrapper.main_text(PAGE.replace("{i}", "same"), None, None)}


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>é{i}</p>") for i in range(3000)] + [(None, None, None), (5, "http://x/5", "again")], "page_id long, url string, html string")
    a = warc.records(pages)
    assert warc.audit(a, a)[1] == [0]
    r = warc.findings(a, warc.records(queries.damaged(pages))).collect()
    status = defaultdict(set)
    for x in r:
        status[x["status"]].add((x["page_id"]))
    assert {i for i in range(3000) if i % 97 == 5 and i < 5} <= status["corrupt"] and len(r) == 3002
    _, counts = warc.audit(a, warc.records(pages.withColumn("html", F.when(F.col("page_id") == 2500, "bad").otherwise(F.col("html")))))
    assert counts[0] == 1 and all(c <= 1024 for c in counts)
    assert warc.findings(warc.records(pages.limit(0)), warc.records(pages.limit(0))).count() == 0
    warc.write_warc(pages.limit(50), str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w"))
    assert sorted(tuple(x) for x in back.collect()) == sorted((x["page_id"], x["url"], x["html"]) for x in pages.limit(50).collect())


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries(spark, name):
    import duckdb

    from tests.test_queries import TABLES, rows

    got = entry.queries()[name](spark, DATA).toPandas()
    assert len(got)
    if name in entry.oracle_sql():
        c = duckdb.connect()
        for t in TABLES:
            c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
        assert rows(got) == rows(c.sql(entry.oracle_sql()[name]).df())


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = table(spark, DATA, "documents")
    kept = docs
    for i, (_, stage) in enumerate(p.STAGES):
        out = stage(spark, kept, DATA).cache()
        if i < 4:
            assert out.columns == docs.columns
        if i < 3:
            assert out.join(kept, docs.columns, "left_anti").count() == 0 and out.count() < kept.count()
        kept = out
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(map(tuple, p.run(spark, DATA).collect()), key=str)
