"""Operators on document texts against plain versions of themselves."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import near_dedup, quality_crf, quality_rules, unigram_counts
from corpusloom.llm import textbatch as tb
from corpusloom.session import table

from .conftest import DATA, EDGES, docs_frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_rules(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), failed


def plain_grams(text):
    d = re.sub(rb"[\x20\x09-\x0D]+", b" ", (text or "").encode())
    return [((d[i] << 16 | d[i + 1] << 8 | d[i + 2]) * 0x9E3779B1 % 2**32) >> 16 for i in range(len(d) - 2)]


def test_quality_rules(spark, rng):
    texts = EDGES + [" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) + rng.choice(["", "\n", "#$"]) for _ in range(60)] + ["the quick brown fox jumps over a lazy dog and runs far away"] * 2
    docs = docs_frame(spark, texts, extra=True)
    target = docs.where("doc_id % 2 = 0").select("doc_id")
    got = {r["doc_id"]: r for r in quality_rules.apply(docs, target).collect()}
    raw, goal = Counter(), Counter()
    for i, t in enumerate(texts):
        raw.update(plain_grams(t))
        goal.update(plain_grams(t) if i % 2 == 0 else [])
    n, m = sum(raw.values()) + 0.5 * quality_rules.BUCKETS, sum(goal.values())
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain_rules(t), t
        g = plain_grams(t)
        p = lambda x: (raw[x] + 0.5) / n
        llr = sum(math.log((goal[x] + 1000 * p(x)) / (m + 1000) / p(x)) for x in g) / max(1, len(g))
        assert r["llr"] == pytest.approx(llr, abs=1e-9)
        assert r["kept"] == (not r["base_failed"] and llr >= quality_rules.THRESHOLD)


def test_quality_rules_empty_tables(spark):
    docs = docs_frame(spark, EDGES)
    assert quality_rules.apply(docs.limit(0), docs.select("doc_id").limit(0)).count() == 0
    got = quality_rules.apply(docs, docs.select("doc_id").limit(0)).collect()
    assert len(got) == len(EDGES) and all(r["llr"] == 0 and r["kept"] == (not r["base_failed"]) for r in got)


def test_crf_marginals_match_enumeration(rng):
    gen = np.random.default_rng(3)
    x, w, t = gen.normal(size=(5, 3)), gen.normal(size=3), gen.normal(size=(2, 2))
    length = np.array([1, 4, 2, 9, 3])
    p = np.zeros(5)
    z = 0.0
    for y in np.ndindex(*[2] * 5):
        e = math.exp(sum(x[i] @ w * y[i] for i in range(5)) + sum(t[y[i], y[i + 1]] for i in range(4)))
        z += e
        p += e * np.array(y)
    assert quality_crf.score(x, np.zeros(5, int), length, 1, w, t)[0] == pytest.approx((p / z * length).sum() / length.sum())


def test_crf_training_gradient():
    """Trained weights separate lines that a feature separates, and neighbours vote."""
    gen = np.random.default_rng(1)
    docs, y = [], np.array([i % 2 for i in range(60)])
    for v in y:
        f = gen.normal(size=(int(gen.integers(1, 9)), 4)).astype(np.float32)
        f[:, 0] += 2 * v - 1
        docs.append(f)
    w, t = quality_crf.train(docs, y)
    assert w[0] > 0 and t[0, 0] + t[1, 1] > t[0, 1] + t[1, 0]
    s = [quality_crf.score(f, np.zeros(len(f), int), np.ones(len(f)), 1, w, t)[0] for f in docs]
    assert np.mean((np.array(s) > 0.5) == y) > 0.9


def test_classifier_held_out(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    out = quality_crf.apply(docs.select("doc_id", "text"), labels)
    r = out.join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0 for x in r)
    assert sum(x["predicted"] == x["quality"] for x in r) / len(r) > 0.95
    flipped = labels.withColumn("quality", F.when(quality_crf.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {x["doc_id"]: x["score"] for x in out.collect()}
    b = {x["doc_id"]: x["score"] for x in quality_crf.apply(docs.select("doc_id", "text"), flipped).collect()}
    assert a == b  # held-out labels are never learnt from


def test_classifier_edges(spark):
    docs = docs_frame(spark, EDGES + ["dup"] * 3, extra=True)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(11)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_crf.apply(docs, labels).collect()}
    assert len(got) == len(EDGES) + 3 and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[0]["score"] == got[1]["score"] and got[8]["score"] == got[9]["score"]
    none = quality_crf.apply(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality_crf.apply(docs.limit(0), labels).count() == 0


def plain_components(texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j in range(i):
                b = sets[j]
                if a and b and 100 * len(a & b) >= 75 * len(a | b) and root[i] != root[j]:
                    x, y = sorted((root[i], root[j]))
                    root = [x if r == y else r for r in root]
                    changed = True
    return [(len(s), r) for s, r in zip(sets, root, strict=True)]


def near_texts(rng):
    words = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    texts = list(EDGES)
    for _ in range(6):  # families with chains, copies and different case
        t = words(rng.randrange(20, 90))
        for _ in range(rng.randrange(2, 9)):
            texts.append(" ".join(t) if rng.random() < 0.5 else " ".join(t).upper())
            t = list(t)
            t[rng.randrange(len(t))] = "edit"
            if rng.random() < 0.5:
                t += words(3)
    base = words(200)
    for _ in range(60):  # a large family, some members beyond the limit
        t = list(base)
        for _ in range(rng.randrange(0, 9)):
            t[rng.randrange(len(t))] = f"e{rng.randrange(9999)}"
        texts.append(" ".join(t))
    texts += [" ".join(words(30)) for _ in range(40)] + ["one", "ONE", "a b c d"]
    rng.shuffle(texts)
    return texts


def test_near_dedup(spark, rng):
    texts = near_texts(rng)
    docs = docs_frame(spark, texts, extra=True)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.assign(docs).collect()}
    want = {i: (n, c, i == c) for i, (n, c) in enumerate(plain_components(texts))}
    assert got == want
    kept = near_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, w in want.items() if w[2])


def test_near_dedup_large_buckets(spark, rng, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 2)
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    texts = near_texts(rng)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.assign(docs_frame(spark, texts)).collect()}
    assert got == {i: c for i, (_, c) in enumerate(plain_components(texts))}


def test_near_dedup_ids(spark):
    t = "a b c d e f g h i j"
    d = spark.createDataFrame([(3, t), (None, t), (5, t), (5, t), (7, "x y z")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in near_dedup.assign(d).collect())
    assert got == [(-1, -1, True), (3, 3, True), (5, 3, False), (5, 3, False), (7, 7, True)]
    assert sorted(r["doc_id"] or -1 for r in near_dedup.deduplicated(d.unionByName(d.where("doc_id = 7"))).collect()) == [-1, 3, 7]
    assert near_dedup.assign(d.limit(0)).count() == 0


def test_sketch_fills_and_estimates():
    gen = np.random.default_rng(2)
    for n in (1, 2, 17, 400, 5000):
        s = np.unique(gen.integers(0, 2**63, n).astype(np.uint64))
        k = near_dedup.sketch(s)
        assert len(k) == near_dedup.T and (k != np.uint64(2**64 - 1)).all()
    a = gen.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:900], gen.integers(0, 2**63, 100).astype(np.uint64)])
    assert abs((near_dedup.sketch(a) == near_dedup.sketch(b)).mean() - 900 / 1100) < 0.1


def test_word_spans_and_hashes(rng):
    import pyarrow as pa

    texts = EDGES + ["".join(rng.choice("ab é\n\t") for _ in range(30)) for _ in range(50)]
    got, hashes, lines = [], {}, []
    for lo, hi, b in tb.chunks(pa.array(texts)):
        s, e, of = b.words()
        h = b.hasher()(s, e)
        for i, j, k, x in zip(s, e, of, h, strict=True):
            w = bytes(b.data[i:j]).decode()
            got.append((lo + k, w))
            assert hashes.setdefault(w, x) == x
        lines += [(lo + t, bytes(b.data[i:j]).decode()) for i, j, t in zip(*b.lines(), strict=True)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t or "")]
    assert len(set(hashes.values())) == len(hashes)
    assert lines == [(i, x) for i, t in enumerate(texts) for x in (t or "").split("\n")]


@pytest.mark.parametrize("fallback", [True, False])
def test_token_counts(spark, rng, fallback):
    from tokenizers import Tokenizer, models, pre_tokenizers

    def reference(pieces, unk, fb):
        t = Tokenizer(models.Unigram(pieces, unk_id=unk, byte_fallback=fb))
        t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        return t

    pieces, unk, _ = unigram_counts.vocabulary(unigram_counts.VOCABULARY)
    t, c = reference(pieces, unk, fallback), unigram_counts.Counter(pieces, unk, fallback)
    texts = [x or "" for x in EDGES] + ["▁▁ x▁y", "☃☃ a☃b", " lead", "tail  "] + [r["text"] for r in table(spark, DATA, "documents").limit(60).collect()]
    assert [c.text(x) for x in texts] == [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    for _ in range(300):  # equal scores: the tokenizer's tie rules
        v = [("<unk>", 0.0)] + [(p, rng.choice([-1.0, -2.0, -1.5])) for p in {"".join(rng.choice("abc▁é") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 9))}]
        x = "".join(rng.choice("abc éd▁") for _ in range(rng.randint(0, 10)))
        assert unigram_counts.Counter(v, 0, False).text(x) == len(reference(v, 0, False).encode(x, add_special_tokens=False).ids)


def test_token_counts_frame(spark):
    docs = docs_frame(spark, EDGES).withColumn("n_tokens", F.lit("x"))
    got = {r["doc_id"]: r["n_tokens"] for r in unigram_counts.token_counts(docs).collect()}
    assert got[0] == got[1] == 0 and got[3] > 0 and len(got) == len(EDGES)
    assert unigram_counts.token_counts(docs.limit(0)).count() == 0
