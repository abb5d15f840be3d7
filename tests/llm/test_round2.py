"""Rows without ids, long chains, wrappers that decide, deep pages, exact hashes: cases of the second round."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import dom, exact_topk, graph, html_wrapper, mixing, near_dedup
from corpusloom.llm.shared import stash
from tests.llm.test_table_ops import plain_top


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def odd_rows():
    """Documents with null, negative and repeated ids, near copies and rows that occur twice."""
    rng = random.Random(1)
    words = "abcdefghij klmno pqrst uvw xyz qwe".split() + [str(i) for i in range(50)]
    base = [[rng.choice(words) for _ in range(40)] for _ in range(30)]
    rows = []
    for i in range(200):
        t = list(rng.choice(base))
        if rng.random() < 0.6:
            t[rng.randrange(40)] = f"z{rng.randrange(9)}"
        rows.append((rng.choice([None, -1, 5, i, i, i, i]), " ".join(t) if rng.random() < 0.95 else rng.choice(["", None, "a b"]), rng.choice(["x", "y", None])))
    return rows + rows[:30]


def test_dedup_and_mix_of_odd_ids(spark):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("th", F.lit("clash")).repartition(4)
    sets = [shingles(r[1]) for r in rows]

    def components(part):
        up = {i: i for i in part}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for i in part:
            for j in part:
                if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    up[root(i)] = root(j)
        out = defaultdict(list)
        for i in part:
            out[root(i)].append(i)
        return list(out.values())

    want = Counter((None, len(sets[i]), None, True) for i, r in enumerate(rows) if r[0] is None)
    for group in components([i for i, r in enumerate(rows) if r[0] is not None]):
        least = min(rows[i][0] for i in group)
        want.update((rows[i][0], len(sets[i]), least, rows[i][0] == least) for i in group)
    assert Counter(tuple(r) for r in near_dedup.assign(docs).collect()) == want
    left = near_dedup.deduplicated(docs)
    assert left.columns == docs.columns
    left = [(r["doc_id"], r["text"], r["source"]) for r in left.collect()]
    named = [r for r in left if r[0] is not None]
    full = [g for g in components([i for i, r in enumerate(rows) if r[0] is not None]) if sets[g[0]]]
    assert sum(bool(shingles(r[1])) for r in named) == len(full) and not Counter(left) - Counter(rows)
    assert Counter(r for r in left if r[0] is None) == Counter(r for r in rows if r[0] is None)
    by_set = {s: k for k, g in enumerate(full) for s in {sets[i] for i in g}}
    least = [min(rows[i][0] for i in g) for g in full]
    for r in named:
        if s := shingles(r[1]):
            assert least[by_set[s]] == r[0]
    # the mix takes as many words as planned, from the sources planned
    plan, out = defaultdict(int), defaultdict(int)
    for r in mixing.mix(docs).collect():
        plan[r["source"]] += r["taken"]
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        out[r["source"]] += len(r["text"].split())
    assert plan == out and sum(plan.values()) > 0


@pytest.mark.parametrize("edges", [[(i + 1, i) for i in range(60)], [(i, 0) for i in range(1, 90)], [(i, 90) for i in range(90)], [(i * 37 % 101, (i + 1) * 37 % 101) for i in range(100)], []])
def test_components_of_chains_and_stars(spark, edges):
    got = graph.components(stash(spark.createDataFrame(edges, "a long, b long"), "edges")).collect()
    assert sorted(r["id"] for r in got) == sorted({x for e in edges for x in e}) and {r["label"] for r in got} <= {0}


def brute_matching(a, f, frame):
    """Size of the largest matching, straight from its definition."""
    if a.tag != frame.nodes[f][0]:
        return 0

    def best(xs, ys):
        if not xs or not ys:
            return 0
        return max(best(xs[:-1], ys), best(xs, ys[:-1]), best(xs[:-1], ys[:-1]) + brute_matching(xs[-1], ys[-1], frame))

    return 1 + best(a.kids, frame.kids[f])


def test_tree_matching_against_its_definition():
    rng = random.Random(7)

    def page(depth=0):
        tag = rng.choice(["div", "p", "section"]) if depth else "body"
        inner = "".join(page(depth + 1) for _ in range(rng.randrange(4))) if depth < 3 and tag != "p" else rng.choice(["x", "y", ""])
        return f"<{tag}>{inner}</{tag}>"

    for _ in range(60):
        a, b = dom.parse(page()), html_wrapper.thaw(html_wrapper.freeze(dom.parse(page())))
        html_wrapper.align(a, b)
        assert sum(n.slot >= 0 for n in a.walk()) == brute_matching(a, 0, b)


def soup(i, rng):
    """A page that names nothing: the menu is constant, the article varies, the advert varies a little."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    paragraphs = [f"Piece {i} {say(rng.randrange(8, 40))}" for _ in range(rng.randrange(2, 9))]
    menu = "".join(f"<div><a href=/{k}>Menu entry {k}</a></div>" for k in range(12))
    body = "".join(f"<p>{t}</p>" for t in paragraphs)
    page = f"<html><body><div>{menu}</div><div>Buy {say(2)} now</div><div><div>{body}</div></div><div>All rights reserved by this host</div></body></html>"
    return page, "\n".join(paragraphs)


def test_only_the_wrapper_finds_the_article(spark):
    rng = random.Random(3)
    pages = [soup(i, rng) for i in range(30)]
    urls = [f"https://h.example/{i}" for i in range(24)] + [f"https://single{i}.example/" for i in range(6)]  # hosts with one page share that layout's wrapper
    d = spark.createDataFrame([(i, u, p) for i, (u, (p, _)) in enumerate(zip(urls, pages, strict=True))], "page_id long, url string, html string")
    for c in ("row", "shape", "host", "frame", "layout", "group", "wrapper"):
        d = d.withColumn(c, F.lit("x"))
    got = html_wrapper.extract(d)
    assert got.columns == [*d.columns, "text", "n_chars"]
    got = {r["page_id"]: r["text"] for r in got.collect()}
    assert [got[i] for i in range(30)] == [t for _, t in pages]
    assert all("Menu entry" in html_wrapper.main_text(p, None, None) for p, _ in pages)  # nothing else tells


def test_deep_and_wide_pages(spark):
    deep = "<div>" * 3000 + "deep text" + "</div>" * 3000
    wide = "<body><div>" + "".join(f"<div><p>paragraph {k}</p></div>" for k in range(2000)) + "</div></body>"
    d = spark.createDataFrame([(i, "https://h.example/", deep.replace("text", f"text {i}")) for i in range(7)] + [(10 + i, "https://w.example/", wide.replace("paragraph", f"paragraph {i}")) for i in range(6)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_wrapper.extract(d).collect()}
    assert all(got[i] == f"deep text {i}" for i in range(7)) and got[12].startswith("paragraph 2 0\nparagraph 2 1") and got[12].count("\n") == 1999


@pytest.mark.parametrize("raw", ['<svg class="i"/>', "<object data=x>", "<iframe src=x>", "<button>Click me</button>", "<svg><path/></svg>", "<select><option>o</select>"])
def test_raw_elements_end_no_page(raw):
    assert html_wrapper.main_text(f"<p>a</p>{raw}<p>b</p>", None, None) == "a\nb"


def test_class_words_drop_no_article():
    for c in ("layout with-sidebar", "share-price-story"):
        assert html_wrapper.main_text(f'<body><div class="{c}"><article><p>Long article</p></article></div></body>', None, None) == "Long article"


def test_warc_of_odd_ids(spark, tmp_path):
    from corpusloom.llm import queries, warc

    rows = [(i, f"u{i}", f"<p>{i}\r\n\r\n</p>") for i in [*range(-5000, -4000, 7), -1, 0, 1, 1 << 60, -(1 << 60)]]
    rows += [(None, "n", str(k % 50)) for k in range(120)] + [(9, "u", "same")] * 40 + [(9, "u", str(k)) for k in range(30)]
    schema = "page_id long, url string, html string"
    d = spark.createDataFrame(rows, schema).withColumn("digest", F.lit("clash"))
    a = warc.records(d)
    got = a.collect()
    assert len(got) == len(rows) and len({(r["no"], r["slot"], r["occ"]) for r in got}) == len(rows)
    by_file = defaultdict(list)
    for r in got:
        by_file[r["no"]].append(r)
    for f in by_file.values():  # offsets follow each other
        f.sort(key=lambda r: r["pos"])
        assert [r["pos"] for r in f] == list(range(len(f))) and f[0]["start"] == 0 and all(x["end"] == y["start"] for x, y in zip(f, f[1:]))
    lost = [(None, "n", "7"), (9, "u", "same"), (9, "u", "12"), (-1, "u-1", "<p>-1\r\n\r\n</p>")]
    rest = list(rows)
    for x in lost:
        rest.remove(x)
    rest[rest.index((0, "u0", "<p>0\r\n\r\n</p>"))] = (0, "u0", "bad")
    found = Counter((r["page_id"], r["status"]) for r in warc.findings(a, warc.records(spark.createDataFrame(rest, schema))).collect() if r["status"] in ("missing", "extra", "corrupt"))
    assert found == Counter({(None, "missing"): 1, (9, "missing"): 2, (-1, "missing"): 1, (0, "corrupt"): 1})
    warc.write_warc(d, str(tmp_path / "w"), 100)
    assert Counter(tuple(r) for r in warc.read_warc(spark, str(tmp_path / "w")).collect()) == Counter(rows)
    with pytest.raises(ValueError):
        list(warc.parse_warc(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))
    with pytest.raises(ValueError):
        list(warc.parse_warc(b"garbage"))
    small = spark.createDataFrame([(i, "u", str(i)) for i in range(250)], schema)
    status = defaultdict(list)
    for r in warc.findings(warc.records(small), warc.records(queries.damaged(small))).collect():
        status[r["status"]].append(r["page_id"])
    assert sorted(status["missing"]) == [7, 218] and sorted(status["corrupt"]) == [5, 102, 199]


def test_hashes_of_regular_texts():
    """The Thue-Morse string and its complement have one hash modulo any power of two."""
    import pyarrow as pa

    from corpusloom.llm import quality_rules
    from corpusloom.llm import textbatch as tb

    tm = "".join("ab"[i.bit_count() % 2] for i in range(4096))
    other = tm.translate(str.maketrans("ab", "ba"))
    (_, _, b), = tb.chunks(pa.array([f"{tm}\n{other}", f"{tm}\n{tm}", "x" * (3 << 20)]).slice(0, 2))
    assert quality_rules.base_counts(b)["n_dup_lines"].tolist() == [0, 1]
    long = " ".join(f"w{i}" for i in range(300_000))  # one text of several chunks' size
    sets = near_dedup.sets_of(pa.array([long, long + " z", None]))
    assert len(sets[0]) == 299_996 and len(set(sets[1]) - set(sets[0])) == 1 and len(sets[2]) == 0


def test_crf_gradient_against_differences():
    import numpy as np

    from corpusloom.llm import quality_crf

    gen = np.random.default_rng(4)
    docs = [gen.normal(size=(n, 3)) for n in (1, 2, 5, 4, 1)]
    labels = [gen.integers(0, 2, len(x)) for x in docs]
    value = quality_crf.Likelihood(docs, labels)
    w, t = gen.normal(size=3), gen.normal(size=(2, 2))
    v, gw, gt = value(w, t)
    # the value by enumeration
    import itertools

    def path(x, y):
        u = x @ w / 2
        return sum(a if k else -a for a, k in zip(u, y, strict=True)) + sum(t[p, q] for p, q in zip(y, y[1:]))

    brute = sum(path(x, list(y)) - np.log(sum(np.exp(path(x, z)) for z in itertools.product((0, 1), repeat=len(x)))) for x, y in zip(docs, labels, strict=True))
    assert abs(v - brute) < 1e-9
    for i in range(3):
        step = np.eye(3)[i] * 1e-6
        assert abs((value(w + step, t)[0] - value(w - step, t)[0]) / 2e-6 - gw[i]) < 1e-4
    for i in range(4):
        step = np.eye(4)[i].reshape(2, 2) * 1e-6
        assert abs((value(w, t + step)[0] - value(w, t - step)[0]) / 2e-6 - gt.ravel()[i]) < 1e-4


def test_crf_learns_changes_inside_a_document():
    import numpy as np

    from corpusloom.llm import quality_crf

    gen = np.random.default_rng(5)
    docs, y = [], []
    for i in range(60):
        bad = i % 2
        x = gen.normal(scale=0.3, size=(15, 2))
        x[:, 0] += 1
        if bad:
            x[1:, 0] -= 2  # a good head, then junk
        docs.append(x.astype(np.float32))
        y.append(1 - bad)
    w, t = quality_crf.train(docs, np.array(y))
    p = quality_crf.marginals(docs[1], np.zeros(15, int), w, t)
    assert p[0] > 0.5 and p[14] < 0.1


def test_best_fit_of_counts_is_best_fit_of_pieces():
    """Packing by counts gives the bins that packing piece by piece gives."""
    from corpusloom.llm import packing

    rng = random.Random(11)
    for _ in range(100):
        counts = {rng.randint(1, 64): rng.randint(1, 12) for _ in range(rng.randint(1, 14))}
        left, bins = dict(counts), []  # a bin is [capacity, room, lengths]
        for size in sorted(counts, reverse=True):
            for _ in range(counts[size]):
                fits = [b for b in bins if b[1] >= size]
                if fits:
                    b = min(fits, key=lambda b: b[1])
                else:
                    lengths = sorted(n for n in left if left[n])
                    b = [min((c for c in (16, 32, 64) if c >= size), key=lambda c: (c * (1 + c / 8192) / packing.foreseen(c, size, lengths, left), c)), 0, []]
                    b[1] = b[0]
                    bins.append(b)
                b[1] -= size
                b[2].append(size)
            left[size] = 0
        placed, got = packing.pack_counts(counts, (16, 32, 64))
        made = sum(n for _, n, _ in got)
        assert sum(e * n * z for z, _, _, n, e, _ in placed) == sum(n * c for n, c in counts.items())
        cost = sum(n * c for _, n, c in got)
        want = sum(next(c for c in (16, 32, 64) if c >= b[0] - b[1]) for b in bins)
        assert made <= len(bins) * 1.1 + 1 and cost <= want * 1.1 + 16


def test_query_blocks_go_no_farther_than_lengths_allow(spark, monkeypatch):
    gen = np.random.default_rng(5)
    base = gen.normal(size=(800, 6))
    base *= (np.geomspace(30, 0.05, 800) / np.linalg.norm(base, axis=1))[gen.permutation(800), None]
    rows = [(i, [float(np.float32(x)) for x in e]) for i, e in enumerate(base)]
    tables = {}
    plain = exact_topk.stash
    monkeypatch.setattr(exact_topk, "stash", lambda df, name: tables.setdefault(name, plain(df, name)))
    monkeypatch.setattr(exact_topk, "BLOCK", 64)
    monkeypatch.setattr(exact_topk, "RANGE", 64)
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in exact_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == plain_top(rows)
    parts = tables["blocks"].agg(F.max("part")).first()[0]
    assert parts > 4 and tables["bounded"].agg(F.max("upto")).first()[0] < parts


def test_topk_sends_the_driver_no_block_of_each_task(spark, monkeypatch):
    """Only the longest block goes to the driver: each collected row of candidates is asked for by its number."""
    gen = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in e]) for i, e in enumerate(gen.normal(size=(900, 8)))]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    sorts = []
    frame = type(d)
    plain = frame.orderBy
    monkeypatch.setattr(frame, "orderBy", lambda self, *a, **b: sorts.append(self.columns) or plain(self, *a, **b))
    monkeypatch.setattr(exact_topk, "BLOCK", 32)
    monkeypatch.setattr(exact_topk, "RANGE", 64)
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in exact_topk.top_k(d).collect()}
    assert got == plain_top(rows)
    assert sorts and not any("rows" in c for c in sorts)


def test_topk_of_few_long_ranges_groups_and_ties(spark, monkeypatch):
    gen = np.random.default_rng(9)
    base = np.concatenate([gen.integers(-2, 3, size=(700, 4)).astype(float), gen.normal(size=(200, 4)) * 1e4, np.ones((60, 4))])
    rows = [(int(i) * 10, [float(np.float32(x)) for x in e]) for i, e in zip(gen.permutation(len(base)), base, strict=True)]
    for name, x in (("BLOCK", 32), ("QUERIES", 8), ("RANGE", 16), ("RANGES", 5), ("GROUP_BYTES", 6000)):
        monkeypatch.setattr(exact_topk, name, x)
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in exact_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)).collect()}
    assert got == plain_top(rows)


def plain_matching(a, f, frame):
    """Size of the largest matching by whole tables, without any trimming."""
    if a.tag != frame.nodes[f][0]:
        return 0
    last = [0] * (len(frame.kids[f]) + 1)
    for x in a.kids:
        row = [0]
        for j, y in enumerate(frame.kids[f]):
            row.append(max(row[j], last[j + 1], last[j] + plain_matching(x, y, frame)))
        last = row
    return 1 + last[-1]


def test_long_lists_match_far_from_their_diagonal(monkeypatch):
    lists, paragraphs = "<ul><li>x</li></ul>" * 300, "".join(f"<p>t {k}</p>" for k in range(200))
    frame = html_wrapper.thaw(html_wrapper.freeze(dom.parse(f"<body>{paragraphs}{'<ul><li>x</li></ul>' * 100}</body>")))
    page = dom.parse(f"<body>{lists}{paragraphs}</body>")
    assert all(same for _, _, same in html_wrapper.align(page, frame))  # each paragraph with its own
    assert sum(n.slot >= 0 for n in page.walk()) == plain_matching(page, 0, frame)
    rng = random.Random(4)
    items = ["<p>x</p>", "<div>y</div>", "<ul><li>z</li></ul>", "<div><p>a</p></div>", "<div><p>a</p><p>b</p></div>"]
    for k in range(8):
        a, b = ("<body>" + "".join(rng.choice(items) for _ in range(rng.randrange(40, 160))) + "</body>" for _ in range(2))
        got = []
        for cells, wide in ((1 << 22, 48), (50, 48), (50, 1000)):  # sizes at which tables are kept or made otherwise: equal results
            monkeypatch.setattr(html_wrapper, "CELLS", cells)
            monkeypatch.setattr(html_wrapper, "WIDE", wide)
            page, frame = dom.parse(a), html_wrapper.thaw(html_wrapper.freeze(dom.parse(b)))
            html_wrapper.align(page, frame)
            got.append([n.slot for n in page.walk()])
        assert got[0] == got[1] == got[2] and sum(x >= 0 for x in got[0]) == plain_matching(page, 0, frame)


def test_template_is_told_in_long_pages_too(spark):
    """A long constant list after a long varying one is template, however far the varying one moves it."""
    rng = random.Random(6)
    foot = "".join(f"<section><h3>Partner {k} of this host</h3></section>" for k in range(300))
    pages = []
    for i in range(8):
        lines = [f"Line {k} of piece {i} {rng.randrange(10**6)}" for k in range(1 if i % 2 else 400)]
        pages.append((i, "https://h.example/", "<body><div>" + "".join(f"<p>{x}</p>" for x in lines) + foot + "</div></body>", "\n".join(lines)))
    got = html_wrapper.extract(spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {p[0]: p[3] for p in pages}
