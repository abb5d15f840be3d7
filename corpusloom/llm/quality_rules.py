"""Quality rules: line, word and symbol statistics with fixed rules, then a hashed n-gram likelihood ratio.

Two multinomials over hashed n-grams of three bytes are counted, over all documents (raw corpus) and over the
trusted documents (target). A document's score is the mean over its n-grams of log(p_target / p_raw); it is
kept if no base rule fails and the score reaches a fixed threshold, so the verdict on a document is
deterministic. Target probabilities are smoothed with the raw ones (weight SMOOTHING n-grams): with no trusted
document every score is 0 and the base rules alone decide.

The two counts have BUCKETS entries whatever the size of the corpus; they are summed within each task first.
Cases: null and empty texts have no words and fail the base rules; white space runs count as one blank;
repeated rows get equal verdicts; columns of the input with an output's name are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import textbatch as tb
from corpusloom.llm.arrowmap import append, field
from corpusloom.llm.shared import small_side

BUCKETS = 1 << 16
SMOOTHING = 1000.0
#: Clean documents of a language that the target has less of score a little under 0; junk scores far lower.
THRESHOLD = -0.3
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOL = tb.table_of("#*$%&|<>")


def base_counts(b: tb.Batch) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    start, end, of = b.words()
    hasher = b.hasher()
    cps = ~tb.IS_SPACE[b.data] & ~tb.IS_CONT[b.data]
    out = {
        "n_words": np.bincount(of, minlength=b.n),
        "word_chars": tb.sums(cps, b.off[:-1], b.off[1:]),
        "n_symbols": tb.sums(SYMBOL[b.data], b.off[:-1], b.off[1:]),
    }
    ls, le, lt = b.lines()
    full = tb.sums(~tb.IS_SPACE[b.data], ls, le) > 0
    ls, le, lt = ls[full], le[full], lt[full]
    again = repeated(hasher(ls, le), lt, first_too=False)
    out["n_dup_lines"] = np.bincount(lt[again], minlength=b.n)
    gram, at = tb.ngrams(hasher(start, end), of, WINDOW)
    hit = at[repeated(gram, of[at], first_too=True)]
    cover = np.zeros(len(of) + WINDOW, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(of[np.cumsum(cover)[: len(of)] > 0], minlength=b.n)
    return out


def repeated(h: np.ndarray, of: np.ndarray, first_too: bool) -> np.ndarray:
    """Which entries equal another one of the same text: all of them, or all but the first."""
    if not len(h):
        return np.zeros(0, bool)
    order = np.lexsort((h, of))
    same = (h[order][1:] == h[order][:-1]) & (of[order][1:] == of[order][:-1])
    out = np.zeros(len(h), bool)
    out[order[1:]] = same
    if first_too:
        out[order[:-1]] |= same
    return out


def grams(b: tb.Batch) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text index of each n-gram of three bytes; a run of white space is one blank."""
    space = tb.IS_SPACE[b.data]
    keep = np.ones(len(space), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    first = b.off[:-1]
    keep[first[first < len(space)]] = True
    at = np.flatnonzero(keep)
    d = np.where(space[at], 32, b.data[at]).astype(np.uint32)
    of = np.repeat(np.arange(b.n), np.diff(b.off))[at]
    m = len(d) - 2
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = (d[:m] << np.uint32(16) | d[1 : m + 1] << np.uint32(8) | d[2:]) * np.uint32(0x9E3779B1)
    inside = of[:m] == of[2:]
    return (g[inside] >> np.uint32(16)).astype(np.int64), of[:m][inside]


def fit(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """Log ratio of each bucket. target: a column doc_id of trusted documents, each once."""
    marked = docs.select("doc_id", "text").join(small_side(target.select("doc_id", F.lit(True).alias("_trusted"))), "doc_id", "left").select("text", "_trusted")

    def count(batches):
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            trusted = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            for lo, hi, b in tb.chunks(batch.column(0)):
                g, of = grams(b)
                total[0] += np.bincount(g, minlength=BUCKETS)
                total[1] += np.bincount(g[trusted[lo:hi][of]], minlength=BUCKETS)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[0][at]), pa.array(total[1][at])], names=["bucket", "raw", "target"])

    counts = marked.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, goal = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = counts["bucket"].to_numpy()
    raw[at], goal[at] = counts["raw"].to_numpy(), counts["target"].to_numpy()
    p = (raw + 0.5) / (raw.sum() + 0.5 * BUCKETS)
    return np.log((goal + SMOOTHING * p) / (goal.sum() + SMOOTHING)) - np.log(p)


FIELDS = [field(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [field("base_failed", T.BooleanType()), field("kept", T.BooleanType()), field("llr", T.DoubleType())]


def apply(docs: DataFrame, target: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with the statistics, `base_failed`, `llr` (mean log ratio; 0 without n-grams) and `kept`."""
    weights = fit(docs, target).astype(np.float64)
    text = docs.columns.index("text")

    def make(batch: pa.RecordBatch) -> list:
        parts: dict[str, list] = {f.name: [] for f in FIELDS}
        for _, _, b in tb.chunks(batch.column(text)):
            c = base_counts(b)
            g, of = grams(b)
            n = np.bincount(of, minlength=b.n)
            c["llr"] = np.bincount(of, weights=weights[g], minlength=b.n) / np.maximum(n, 1)
            c["base_failed"] = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
            c["kept"] = ~c["base_failed"] & (c["llr"] >= threshold)
            for k, v in c.items():
                parts[k].append(v)
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
        return [pa.array(np.concatenate(parts[f.name]) if parts[f.name] else [], kind) for f, kind in zip(FIELDS, kinds, strict=True)]

    return append(docs, FIELDS, make)


def trusted(labels: DataFrame) -> DataFrame:
    """The trusted target: documents whose label says quality 1 (in every row that they have)."""
    return labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
