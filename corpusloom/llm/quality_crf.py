"""Quality classifier: a linear-chain conditional random field over a document's lines.

Every \\n-split line is labelled good or bad from its own features, those of the line before and of the line
after, and the label of its neighbours. The field is trained here on documents' labels (see `train`), on a bounded sample (SAMPLE
labelled documents, all lines of each, of no more documents than reach TRAIN_LINES lines; scoring has no such bound). A document's score is the mean of its lines' marginal probabilities of "good",
by forward-backward, weighted by length in bytes.

Inputs of a score are the text only. Cases: null and empty texts are one empty line of weight 1; without
labels of both classes every score is the smoothed share of label 1; repeated rows get equal scores; very long
texts take time in proportion; columns of the input with an output's name are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import textbatch as tb
from corpusloom.llm.arrowmap import append, field
from corpusloom.llm.shared import stash

SAMPLE = 4000
#: Lines of all sampled documents together: with the one that passes this, no further document is learnt from.
TRAIN_LINES = 240_000
KEEP_AT = 0.3
#: Probability by itself from which a line of a bad document is taken for good.
CLEAR = 0.9
SYMBOL = tb.table_of("#*$%&|<>")
UPPER = tb.table_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
ALPHA = UPPER | tb.table_of("abcdefghijklmnopqrstuvwxyz")
ALPHA[0xC3:0xF5] = True
DIGIT = tb.table_of("0123456789")
BANG = tb.table_of("!?")
POINT = tb.table_of(".,;:-_()[]{}'\"/\\@=+~^`")
OWN = 15


def line_features(b: tb.Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, text index, length) of each line; features of the lines before and after follow the own ones."""
    ls, le, lt = b.lines()
    n = len(ls)
    ws, we, _ = b.words()
    wl = np.searchsorted(ls, ws, side="right") - 1
    # of lines that start at the same byte only the last can hold a word
    count = np.bincount(wl, minlength=n).astype(float)
    some = np.maximum(count, 1)
    size = np.maximum(tb.sums(~tb.IS_SPACE[b.data], ls, le), 1).astype(float)
    share = lambda table: tb.sums(table[b.data], ls, le)
    hasher = b.hasher()
    h = hasher(ws, we)
    order = np.lexsort((h, wl))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (wl[order][1:] != wl[order][:-1])
    distinct = np.bincount(wl[order][new], minlength=n)
    stutter = np.bincount(wl[1:][(h[1:] == h[:-1]) & (wl[1:] == wl[:-1])], minlength=n)
    lh = hasher(ls, le)
    order = np.lexsort((lh, lt))
    twin = np.zeros(n, bool)
    twin[order[1:]] = (lh[order][1:] == lh[order][:-1]) & (lt[order][1:] == lt[order][:-1])
    twin &= count > 0
    letters = np.maximum(share(ALPHA), 1)
    x = np.stack(
        [
            np.ones(n), count == 0, np.log1p(count) / 5, share(UPPER) / letters, np.minimum(share(SYMBOL) / some, 3), np.minimum(share(BANG) / some, 3),
            share(DIGIT) / size, np.minimum(share(POINT) / some, 3), np.minimum(size / some, 30) / 10, 1 - distinct / some, stutter / some, twin,
            share(ALPHA) / size, (1 - distinct / some) * (count > 20), np.minimum(count, 3) / 3,
        ],
        axis=1,
    ).astype(np.float32)
    near = np.zeros((n, 2 * OWN), np.float32)
    same = lt[1:] == lt[:-1]
    near[1:, :OWN][same] = x[:-1][same]
    near[:-1, OWN:][same] = x[1:][same]
    return np.concatenate([x, near], axis=1), lt, np.maximum(le - ls, 1)


class Likelihood:
    """Log likelihood of labelled documents (a label for each line) and its gradient, all documents side by side."""

    def __init__(self, docs: list[np.ndarray], labels: list[np.ndarray]):
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        length = np.array([len(docs[i]) for i in order])
        self.longest, self.d = int(length[0]), docs[0].shape[1]
        self.active = [int((length > k).sum()) for k in range(self.longest)]  # the documents with a line k come first
        self.flat = np.concatenate([np.stack([docs[i][k] for i in order[:a]]) for k, a in enumerate(self.active)]).astype(float)
        self.cut = np.cumsum(self.active)[:-1]
        y = [np.array([labels[i][k] for i in order[:a]], int) for k, a in enumerate(self.active)]
        self.y = np.concatenate(y)
        self.seen_w = self.flat.T @ self.y.astype(float)
        self.seen_t = np.zeros((2, 2))
        for k in range(1, self.longest):
            np.add.at(self.seen_t, (y[k - 1][: self.active[k]], y[k]), 1)

    def __call__(self, w: np.ndarray, t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        longest, active = self.longest, self.active
        u = np.clip(self.flat @ w, -30, 30) / 2
        e = np.split(np.stack([np.exp(-u), np.exp(u)], axis=1), self.cut)
        et = np.exp(t)
        norm = e[0].sum(1, keepdims=True)
        fwd, log_z = [e[0] / norm], float(np.log(norm).sum())
        for k in range(1, longest):
            a = (fwd[-1][: active[k]] @ et) * e[k]
            norm = a.sum(1, keepdims=True)
            log_z += float(np.log(norm).sum())
            fwd.append(a / norm)
        back = np.full((active[-1], 2), 0.5)
        p, joint = [None] * longest, np.zeros((2, 2))
        for k in range(longest - 1, -1, -1):
            q = fwd[k] * back
            p[k] = q[:, 1] / q.sum(1)
            if k:
                ahead = e[k] * back
                pair = fwd[k - 1][: active[k], :, None] * et * ahead[:, None, :]
                joint += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
                a = ahead @ et.T
                back = np.full((active[k - 1], 2), 0.5)
                back[: active[k]] = a / a.sum(1, keepdims=True)
        value = float((u * (2 * self.y - 1)).sum() + (self.seen_t * t).sum()) - log_z
        return value, self.seen_w - self.flat.T @ np.concatenate(p), self.seen_t - joint


def climb(docs: list[np.ndarray], labels: list[np.ndarray], steps: int, l2: float, chain: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the greatest likelihood less l2 times half of their squares (full-batch Adam); transitions stay 0 without chain."""
    value = Likelihood(docs, labels)
    d = value.d
    w, t = np.zeros(d), np.zeros((2, 2))
    m = [np.zeros(d + 4), np.zeros(d + 4)]
    for step in range(1, steps + 1):
        _, gw, gt = value(w, t)
        grad = np.concatenate([gw - l2 * w, (gt - l2 * t).ravel()]) / len(value.flat)
        m[0] = 0.9 * m[0] + 0.1 * grad
        m[1] = 0.99 * m[1] + 0.01 * grad**2
        move = 0.15 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
        w, t = w + move[:d], t + move[d:].reshape(2, 2) * chain
    return w, t


def train(docs: list[np.ndarray], labels: np.ndarray, steps: int = 150, l2: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features (for "good") and the 2 x 2 transition scores.

    Only documents are labelled. A first field without transitions learns each line with its document's label; lines of bad
    documents that it finds good by themselves (CLEAR) are labelled good, unless these are half of the document or more. The
    field is then trained on the labels of lines, so it sees documents that go from good to bad.
    """
    lines = [np.full(len(x), y) for x, y in zip(docs, labels, strict=True)]
    w, t = climb(docs, lines, steps, l2, chain=False)
    for i, x in enumerate(docs):
        if labels[i] == 0 and len(x) > 1:
            good = x @ w >= np.log(CLEAR / (1 - CLEAR))
            if 2 * good.sum() < len(x):
                lines[i] = good.astype(int)
    return climb(docs, lines, steps, l2)


def marginals(x: np.ndarray, of: np.ndarray, w: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Probability of "good" of each line, by forward-backward within its text."""
    odds = np.exp(np.clip(x @ w, -30, 30)).tolist()
    (t00, t01), (t10, t11) = np.exp(t).tolist()
    m = len(odds)
    ahead, r = [1.0] * m, 1.0
    text = of.tolist()
    last = -1
    for i in range(m):  # messages as ratios good / bad
        r = 1.0 if text[i] != last else (t11 * r + t01) / (t10 * r + t00)
        ahead[i] = r
        r *= odds[i]
        last = text[i]
    back, r, last = [1.0] * m, 1.0, -1
    for i in range(m - 1, -1, -1):
        r = 1.0 if text[i] != last else (t11 * r + t10) / (t01 * r + t00)
        back[i] = r
        r *= odds[i]
        last = text[i]
    o = np.array(odds) * np.array(ahead) * np.array(back)
    return o / (1 + o)


def score(x: np.ndarray, of: np.ndarray, length: np.ndarray, n: int, w: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Length-weighted mean marginal of each of n texts."""
    p = marginals(x, of, w, t)
    return np.bincount(of, weights=p * length, minlength=n) / np.bincount(of, weights=length, minlength=n)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray] | float:
    """The trained field, or the smoothed share of label 1 if the sample doesn't have both labels."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("_y"))
    picked = known.orderBy(F.xxhash64(F.lit("crf"), "doc_id"), "doc_id").limit(sample)

    def features(batches):
        for batch in batches:
            for lo, hi, b in tb.chunks(batch.column(1)):
                x, of, _ = line_features(b)
                cut = np.searchsorted(of, np.arange(b.n + 1))
                blobs = [x[cut[i] : cut[i + 1]].tobytes() for i in range(b.n)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(2)[lo:hi], pa.array(np.diff(cut), pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "_y", "n", "x"])

    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "_y").mapInArrow(features, "doc_id long, _y int, n long, x binary")
    rows = stash(rows, "features")
    sizes = rows.groupBy("doc_id").agg(F.sum("n").alias("n")).orderBy(F.xxhash64(F.lit("crf"), "doc_id"), "doc_id").toArrow()  # at most `sample` rows
    before = np.concatenate([[0], np.cumsum(sizes["n"].to_numpy())])[:-1]
    if (before >= TRAIN_LINES).any():
        rest = [int(i) for i, n in zip(sizes["doc_id"].to_pylist(), before, strict=True) if n >= TRAIN_LINES]
        rows = rows.where(~F.col("doc_id").isin(rest))
    rows = rows.drop("n").toArrow()
    rows = sorted(set(zip(rows["doc_id"].to_pylist(), rows["_y"].to_pylist(), rows["x"].to_pylist(), strict=True)))
    y = np.array([r[1] for r in rows], int)
    if not len(y) or y.min() == y.max():
        return (y.sum() + 1.0) / (len(y) + 2.0)
    return train([np.frombuffer(r[2], np.float32).reshape(-1, 3 * OWN) for r in rows], y)


FIELDS = [field("held_out", T.BooleanType()), field("score", T.DoubleType()), field("predicted", T.IntegerType())]


def apply(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with `held_out` (never learnt from), `score` and `predicted`."""
    model = fit(docs, labels)
    text = docs.columns.index("text")

    def make(batch: pa.RecordBatch) -> list:
        out = []
        for _, _, b in tb.chunks(batch.column(text)):
            if isinstance(model, float):
                out.append(np.full(b.n, model))
            else:
                x, of, length = line_features(b)
                out.append(score(x, of, length, b.n, *model))
        s = np.clip(np.concatenate(out) if out else np.zeros(0), 0.0, 1.0)
        return [pa.array(s, pa.float64()), pa.array((s >= KEEP_AT).astype(np.int32), pa.int32())]

    names = {f.name for f in FIELDS}
    scored = append(docs, FIELDS[1:], make)
    return scored.select(*[c for c in docs.columns if c.lower() not in names], held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
