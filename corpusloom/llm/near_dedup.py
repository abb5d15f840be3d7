"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set holds the hashes (64 bits) of its distinct 5-word shingles, A-Z lower-cased. Its sketch has
T coordinates, filled by rounds (Dahlgaard, Knudsen and Thorup, 2017): in round i < T every element draws a
bin and a value in [i, i + 1), in round T + j all elements go to bin j; a bin keeps its least value, and rounds
end when no bin is empty, which the last T rounds guarantee. For large sets one round or two suffice, so a sketch
takes time in proportion to n + T log T, not n * T, and estimates stay concentrated as with T independent
minima. ROWS coordinates make a band; documents that share a band's bucket are candidates (a pair of similarity
0.75 shares none with probability under 4e-6, of 0.8 under 4e-9), and every link rests on the whole sets.

Documents with equal sets are first collapsed into classes (by set size and 128 bits of hash). No bucket emits
all its pairs: (1) every class is compared with the bucket's least class, first one, then the others that
aren't connected yet; (2) only classes of one bucket that are still in different components are compared with
each other, leaving out pairs inside its largest component (in small buckets as pairs, in large ones block
against block). So no link between components is lost, and a group
of n near copies costs about n comparisons.

Hashes of 64 bits stand for shingles; spans of bytes get them from two moduli, mixed (textbatch). A pair's texts meet
dealt by (row, share of its partners), so a text that is compared with very many others isn't one task's work.

Nodes of the graph are classes, not ids, so rows that repeat a doc_id with other texts are documents of their own.
Cases: null or empty texts, and texts without a word, have an empty set and no link; with fewer than five words
the whole sequence is one shingle; very long texts are one set each, held by one task at a time; rows without a
doc_id take no part and are kept; rows of one doc_id get a component each by their texts; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import textbatch as tb
from corpusloom.llm.graph import components
from corpusloom.llm.shared import lookup, small_side, stash, unstash

U = np.uint64
SHINGLE = 5
PERCENT = 75
ROWS, BANDS = 6, 64
T = ROWS * BANDS
#: Members of a bucket up to which its pairs are rows; classes in a block of a larger one.
SMALL, BLOCK = 24, 128
#: Shingles in a block, about: it then has fewer members. Pairs of one node that meet in a task.
BLOCK_SHINGLES, PARTNERS = 1 << 17, 256
_SEEDS = tb.mix(np.arange(1, 2 * T + 1, dtype=U) * U(0x9E3779B97F4A7C15))


def shingle_sets(b: tb.Batch) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    b = b.lower()
    start, end, of = b.words()
    h = b.hasher()(start, end)
    gram, at = tb.ngrams(h, of, SHINGLE)
    cut = np.searchsorted(of[at], np.arange(b.n + 1))
    word = np.searchsorted(of, np.arange(b.n + 1))
    out = []
    for i in range(b.n):
        n = word[i + 1] - word[i]
        if n >= SHINGLE:
            out.append(np.unique(gram[cut[i] : cut[i + 1]]))
        elif n:
            out.append(tb.ngrams(h[word[i] : word[i + 1]], np.zeros(n, np.int64), int(n))[0])
        else:
            out.append(np.zeros(0, U))
    return out


def sketch(s: np.ndarray, t: int = T) -> np.ndarray:
    """t coordinates (round << 32 | value) of a non-empty set. More rounds than needed change nothing: their values are larger."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(t, full, U)
    step = min(t, max(1, math.ceil(t * (math.log(t) + 2) / len(s))))
    step = min(step, max(1, (1 << 18) // len(s)))
    done = 0
    while done < t and (out == full).any():
        r = np.arange(done, min(done + step, t))
        h = tb.mix(s[None, :] ^ _SEEDS[r][:, None])
        bins = ((h >> U(32)) * U(t)) >> U(32)
        np.minimum.at(out, bins.ravel().astype(np.int64), ((h & U(0xFFFFFFFF)) | (r.astype(U) << U(32))[:, None]).ravel())
        done = int(r[-1]) + 1
    for j in np.flatnonzero(out == full):
        out[j] = (tb.mix(s ^ _SEEDS[t + j]) & U(0xFFFFFFFF)).min() | U((t + int(j)) << 32)
    return out


def band_keys(sk: np.ndarray, rows: int = ROWS) -> np.ndarray:
    x = sk.reshape(-1, rows)
    k = np.arange(1, len(x) + 1, dtype=U) * U(0xD6E8FEB86659FD93)
    for i in range(rows):
        k = tb.mix(k ^ x[:, i])
    return k.view(np.int64)


def text_hash(text=None):
    return F.xxhash64(F.lit("text"), F.col("text") if text is None else text)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, th, n_shingles, h1, h2, bands) of each row; th: hash of the text; bands is null for an empty set."""

    def run(batches):
        for batch in batches:
            for lo, hi, b in tb.chunks(batch.column(2)):
                sets = shingle_sets(b)
                n = np.array([len(s) for s in sets], np.int64)
                h1 = np.array([tb.mix(s).sum(dtype=U) for s in sets], U)
                h2 = np.array([tb.mix(s ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=U) for s in sets], U)
                keys = [band_keys(sketch(s)) if len(s) else None for s in sets]
                flat = np.concatenate([k for k in keys if k is not None] or [np.zeros(0, np.int64)])
                off = np.concatenate([[0], np.cumsum([0 if k is None else len(k) for k in keys])])
                bands = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), bands], names=["doc_id", "th", "n_shingles", "h1", "h2", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("th"), "text").mapInArrow(run, "doc_id long, th long, n_shingles long, h1 long, h2 long, bands array<long>")


def sets_of(col: pa.Array) -> list[np.ndarray]:
    return [x for _, _, b in tb.chunks(col) for x in shingle_sets(b)]


def verified(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of the stored pairs (a, b) whose whole sets are similar enough; texts: (node, text) of all that occur.

    b may be one node for a third of all pairs: its pairs are dealt in shares of PARTNERS, and its text goes once to each.
    """

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                other = part.column(3).dictionary_encode()  # rows come sorted by b, so one text stands in many of them
                left, right, at = sets_of(part.column(2)), sets_of(other.dictionary), other.indices.to_numpy()
                for i, x in enumerate(left):
                    y = right[at[i]]
                    if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        keep[lo + i] = 100 * both >= percent * (len(x) + len(y) - both)
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(at), batch.column(1).filter(at)], names=["a", "b"])

    shares = stash(pairs.groupBy("b").agg(F.count("*").alias("pairs"), F.ceil(F.count("*") / PARTNERS).cast("int").alias("shares")), "shares")
    dealt = lookup(pairs, shares, ["b"], "pairs", "inner").select("a", "b", F.pmod(F.xxhash64("a"), F.col("shares")).cast("int").alias("share"))
    right = shares.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    right = right.select("b", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "text_b")
    with_a = dealt.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(right, ["b", "share"])
    return with_b.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def classes_of(sk: DataFrame) -> DataFrame:
    """Stored (node, n_shingles, h1, h2, head, copies, bands): rows with equal sets; head: the first of them by doc_id, then text."""
    full = sk.where("n_shingles > 0 and doc_id is not null")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("head")
    classes = full.groupBy("n_shingles", "h1", "h2").agg(head, F.count("*").alias("copies"), F.first("bands").alias("bands"))
    return stash(classes.withColumn("node", F.monotonically_increasing_id()), "classes")


#: What names a row: its doc_id (null or not) and the hash of its text.
ROW = ["none", "id", "th"]


def named_rows(docs: DataFrame) -> DataFrame:
    """docs with the columns ROW."""
    return docs.withColumns({"none": F.col("doc_id").isNull(), "id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "th": text_hash()})


def texts_of(docs: DataFrame, cls: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """Stored (node, text) of the nodes' heads."""
    heads = stash(cls.join(small_side(nodes), "node", "left_semi").select("node", F.col("head.none").alias("none"), F.coalesce("head.doc_id", F.lit(0)).alias("id"), F.col("head.th").alias("th"), "copies"), "heads")
    found = lookup(named_rows(docs.select("doc_id", "text")).drop("doc_id"), heads, ROW, "copies", "inner", total).select("node", "text")
    return stash(found.dropDuplicates(["node"]), "texts")


def block_links(named: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between components within large buckets: blocks of about BLOCK classes meet, not pairs.

    named: (key, node, label, main, n_main, size, shingles, main_shingles). Classes outside a bucket's largest component are in blocks of
    their own; each of these meets every other block of its bucket once. Inside a meeting, an inverted list of one block's
    shingles gives all sizes of intersections, so a meeting yields links only. Blocks hold fewer classes if these are long.
    """
    other = F.col("label") != F.col("main")
    n = F.when(other, F.col("size") - F.col("n_main")).otherwise(F.col("n_main"))
    long = F.when(other, F.col("shingles") - F.col("main_shingles")).otherwise(F.col("main_shingles"))
    parts = F.least(n, F.greatest(F.ceil(n / BLOCK), F.ceil(long / BLOCK_SHINGLES))).cast("int")
    dealt = named.withColumn("other", other).withColumn("no", F.pmod(F.xxhash64("node"), parts).cast("int"))
    dealt = dealt.select("key", "other", "no", "node", "label").join(texts, "node")
    blocks = dealt.groupBy("key", "other", "no").agg(F.collect_list(F.struct("node", "label", "text")).alias("rows"))
    x = blocks.where("other").select("key", F.col("no").alias("x_no"), F.col("rows").alias("xs"))
    met = x.join(blocks.withColumnRenamed("rows", "ys"), "key").where(~F.col("other") | (F.col("x_no") <= F.col("no")))

    def run(batches):
        for batch in batches:
            a, b = [], []
            for i in range(batch.num_rows):
                left, right = batch.column(0)[i].values, batch.column(1)[i].values
                (xi, xl), (yi, yl) = ((part.field(0).to_numpy(), part.field(1).to_numpy()) for part in (left, right))
                xs, ys = sets_of(left.field(2)), sets_of(right.field(2))
                size = np.array([len(s) for s in ys])
                flat = np.concatenate(ys)
                order = np.argsort(flat, kind="stable")
                flat, owner = flat[order], np.repeat(np.arange(len(ys)), size)[order]
                for k, s in enumerate(xs):
                    lo, n = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
                    n -= lo
                    at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    both = np.bincount(owner[at], minlength=len(ys))
                    hit = np.flatnonzero((100 * both >= percent * (len(s) + size - both)) & (yl != xl[k]))
                    a += np.maximum(yi[hit], xi[k]).tolist()
                    b += np.minimum(yi[hit], xi[k]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return met.select("xs", "ys").mapInArrow(run, "a long, b long")


def link_classes(docs: DataFrame, cls: DataFrame, total: int, percent: int = PERCENT) -> DataFrame:
    """Stored (id, label) of the nodes that have a link."""
    rows = cls.select(F.explode("bands").alias("key"), "node", "n_shingles")
    shared = stash(rows.groupBy("key").agg(F.min("node").alias("rep"), F.count("*").alias("members")).where("members > 1"), "buckets")
    members = stash(lookup(rows, shared, ["key"], "members", "inner"), "members")
    star = stash(members.where("node <> rep").groupBy(F.col("node").alias("a"), F.col("rep").alias("b")).agg(F.count("*").alias("buckets")), "star")
    nodes = stash(members.select("node").distinct(), "nodes")
    texts = texts_of(docs, cls, nodes, total)
    first = stash(star.groupBy("a").agg(F.min("b").alias("b")), "first")
    spent = [shared, members, star, nodes, texts, first]
    links = stash(verified(first, texts, percent), "links")
    labels = components(links)
    more = stash(across(star.join(first, ["a", "b"], "left_anti").select("a", "b"), labels), "more")
    spent += [links, more]
    if more.take(1):
        links = stash(links.unionByName(verified(more, texts, percent)), "links")
        spent += [links, labels]
        labels = components(links)
    # classes of one bucket in different components: all but pairs inside its largest component
    named = members.join(labels.select(F.col("id").alias("node"), "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    counts = named.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    best = F.max(F.struct("n", "label", "s"))
    mixed = counts.groupBy("key").agg(F.count("*").alias("labels"), F.sum("n").alias("size"), F.sum("s").alias("shingles"), best.alias("m")).where("labels > 1")
    mixed = stash(mixed.select("key", "size", "shingles", F.col("m.label").alias("main"), F.col("m.n").alias("n_main"), F.col("m.s").alias("main_shingles"), F.col("size").alias("rows")), "kinds")
    named = stash(lookup(named, mixed, ["key"], "rows", "inner"), "mixed")
    x, y = named.where(F.col("label") != F.col("main")).where(F.col("size") <= SMALL), named.where(F.col("size") <= SMALL)
    near = x.alias("x").join(y.alias("y"), F.expr("x.key = y.key and x.label <> y.label and (y.label = y.main or x.node < y.node) and 100 * least(x.n_shingles, y.n_shingles) >= %d * greatest(x.n_shingles, y.n_shingles)" % percent))
    pairs = near.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()
    rest = stash(pairs.join(star.select("a", "b"), ["a", "b"], "left_anti"), "rest")
    found = verified(rest, texts, percent).unionByName(block_links(named.where(F.col("size") > SMALL), texts, percent))
    found = stash(found.distinct(), "found")
    spent += [mixed, named, rest, found]
    if found.take(1):
        links = stash(links.unionByName(found), "links")
        spent += [links, labels]
        labels = components(links)
    unstash(*spent)
    return labels


def across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends aren't in one component; a left end has few pairs, a right one may have very many."""
    left = pairs.join(labels.select(F.col("id").alias("a"), F.col("label").alias("label_a")), "a", "left")
    of_b = stash(pairs.groupBy("b").agg(F.count("*").alias("pairs")).join(labels.select(F.col("id").alias("b"), F.col("label").alias("label_b")), "b"), "ends")
    out = lookup(left, of_b, ["b"], "pairs", "left")
    return out.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")


def heads(cls: DataFrame, labels: DataFrame) -> DataFrame:
    """Stored (n_shingles, h1, h2, copies, head): each class with the first row of its component."""
    linked = cls.drop("bands").join(labels.select(F.col("id").alias("node"), "label"), "node", "left")
    of = stash(linked.where("label is not null").groupBy("label").agg(F.min("head").alias("first"), F.count("*").alias("classes")), "firsts")
    lone = linked.where("label is null").select("n_shingles", "h1", "h2", "copies", "head")
    with_first = lookup(linked.where("label is not null"), of, ["label"], "classes", "inner").select("n_shingles", "h1", "h2", "copies", F.col("first").alias("head"))
    return stash(lone.unionByName(with_first), "named")


def verdicts(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, th, n_shingles, head) of each row of docs; head: the first row of its component, null if it takes no part."""
    sk = stash(sketches(docs), "sketches")
    cls = classes_of(sk)
    total = sk.count()
    labels = link_classes(docs, cls, total, percent)
    named = heads(cls, labels)
    unstash(cls, labels)
    head = F.when(F.col("doc_id").isNotNull(), F.col("head"))
    return lookup(sk.drop("bands"), named, ["n_shingles", "h1", "h2"], "copies", "left", total).select("doc_id", "th", "n_shingles", head.alias("head"))


def assign(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs."""
    v = verdicts(docs, percent)
    component = F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id"))
    return v.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component, the first by doc_id, then by hash of the text.

    Of rows that agree in doc_id and text one stays, the least by a hash of all columns; rows without a doc_id or with an empty set all stay.
    """
    v = verdicts(docs, percent).where("head is not null")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    rows = v.groupBy(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "th").agg(F.count("*").alias("copies"), F.first(own != F.col("head")).alias("drop"))
    told = stash(rows.where("drop or copies > 1"), "told")
    out = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64(*docs.columns).alias("_all"), F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), text_hash().alias("th"))
    out = lookup(out, told, ROW, "copies", "left")
    once = out.where("drop is null")
    if told.where("not drop").take(1):
        w = Window.partitionBy(*ROW).orderBy("_all")
        again = out.where("not drop").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
        once = once.unionByName(again)
    return once.select("_row.*")
