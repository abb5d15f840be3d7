"""Exact top-k inner products: blocks by descending length, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Vectors become integers floor(1024 * x). Their Gram matrix (dimensions squared, summed within tasks) gives the
rotation of the singular value decomposition, under which the first coordinates carry most of the length.
Candidates are dealt in ranges by descending length (at most RANGES) and packed in blocks of BLOCK rows, queries in blocks of
QUERIES rows, both in the narrowest integers that hold them. The block with the longest vectors is scored first and gives every
query a lower bound of its k-th score. Ranges are in order of length, so a query block is sent only as far as some query's length
times the greatest length of the ranges there reaches that query's bound (STEPS runs of ranges are told apart, so what the driver
holds doesn't grow: STEPS rows, one block of candidates, the rotation). A tile is a range and a group of query blocks (of GROUP_BYTES
with their results); its task holds the queries, lets the candidate blocks pass, and keeps each query's k best, whose last one
tightens the bound. A block that passes is skipped for a query by the test of lengths, and within a block a candidate is dropped if
its partial sum over the first HEAD coordinates plus the product of the remaining lengths doesn't reach the bound. What is left is
scored exactly, in integers (floats below 2**24, doubles below 2**53, else Python's).

Cases: vectors null or with null or non-finite components, and rows without vec_id, take no part; shorter vectors
count as filled with zeros; rows that share a query's vec_id are its own; of repeated query ids one row (the
least vector) asks; ties go to the smaller vec_id; scores beyond a long are cut to its range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import stash, unstash

SCALE = 1024
BLOCK = 4096
QUERIES = 512
RANGE = 8192
#: Most ranges; those of more rows than RANGES * RANGE are longer. Each range gets its own copy of the queries.
RANGES = 256
STEPS = 64
GROUP_BYTES = 80 << 20
EXACT = float(1 << 53)
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, an array of floats or doubles) of the rows that take part."""
    ok = F.col("vec_id").isNotNull() & F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    v = F.col("embedding") if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else F.col("embedding").cast("array<double>")
    return vectors.where(F.coalesce(ok, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def matrix(col: pa.Array, d: int) -> np.ndarray:
    """Rows of floor(SCALE * x), filled up to d coordinates."""
    off = col.offsets.to_numpy().astype(np.int64)
    flat = col.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]] if len(col) else np.zeros(0)
    size = np.diff(off)
    out = np.zeros((len(col), d))
    row = np.repeat(np.arange(len(col)), size)
    out[row, np.arange(len(flat)) - np.repeat(off[:-1] - off[0], size)] = flat
    return np.floor(SCALE * out)


def stored(m: np.ndarray) -> bytes:
    """Integer rows in the narrowest of int16, int32 and double that holds them."""
    top = np.abs(m).max(initial=0.0)
    return m.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.float64).tobytes()


def loaded(rows, n: int, d: int) -> np.ndarray:
    kind = {2: np.int16, 4: np.int32, 8: np.float64}[len(rows) // (n * d)]
    return np.frombuffer(rows, kind).reshape(n, d)


def rotation(ints: DataFrame, d: int) -> np.ndarray:
    def gram(batches):
        total = np.zeros((d, d))
        for b in batches:
            m = matrix(b.column(0), d)
            top = np.abs(m).max(initial=1.0)
            total += (m / top).T @ (m / top) * min(top, 1e100) ** 2
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(total.ravel())], names=["i", "x"])

    g = ints.select("v").mapInArrow(gram, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    m = np.zeros(d * d)
    m[g["i"].to_numpy()] = g["x"].to_numpy()
    m = m.reshape(d, d)
    if not np.isfinite(m).all():
        return np.eye(d)
    w, v = np.linalg.eigh((m + m.T) / 2)
    return v[:, np.argsort(-w)]


def products(q: np.ndarray, c: np.ndarray, most: float) -> np.ndarray:
    """Inner products of integer rows, exactly; most: a bound of the rows' lengths and of the products of two lengths."""
    for kind, top in ((np.float32, 1 << 24), (np.float64, EXACT)):
        if most < top:
            return q.astype(kind) @ c.astype(kind, copy=False).T
    qs, cs = [[int(x) for x in r] for r in q], [[int(x) for x in r] for r in c]
    return np.array([[min(HIGH, max(LOW, sum(a * b for a, b in zip(r, s, strict=True)))) for s in cs] for r in qs], np.int64).reshape(len(qs), len(cs))


def exact_dots(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, as int64."""
    x, y = float(np.abs(q).max(initial=0)), float(np.abs(c).max(initial=0))
    return products(q, c, max(x, y, x * y * max(1, q.shape[1]))).astype(np.int64)


class Block:
    """Candidates or queries with their lengths, and with what bounds their products: first rotated coordinates and the length of the others."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, turn: np.ndarray, head: int, keep: bool):
        whole = rows.astype(np.float64)
        turned = whole @ turn
        self.ids, self.rows, self.norm = ids, rows if keep else whole, np.linalg.norm(whole, axis=1)
        self.longest = float(self.norm.max(initial=0.0))
        self.bound = np.hstack([turned[:, :head], np.linalg.norm(turned[:, head:], axis=1)[:, None]])
        if self.longest < 1e15:
            self.bound = self.bound.astype(np.float32)
        if not keep and self.longest < 1e15:
            self.narrow = whole.astype(np.float32)


class Asked(Block):
    """A block of queries with each one's k best candidates so far, and (score, id) that a candidate must reach: (LOW, HIGH) if nothing is known."""

    def __init__(self, ids, rows, turn, head: int, k: int, floor: np.ndarray | None = None):
        super().__init__(ids, rows, turn, head, True)
        n = len(ids)
        self.score, self.who, self.n = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64), np.zeros(n, np.int64)
        self.kth, self.kid = (floor[0].copy(), floor[1].copy()) if floor is not None else (np.full(n, LOW), np.full(n, HIGH))

    def meet(self, c: Block) -> None:
        k, most = self.score.shape[1], max(self.longest, c.longest, self.longest * c.longest)
        floor = np.where(self.kth == LOW, -np.inf, self.kth.astype(np.float64))
        product = self.norm * c.longest
        live = np.flatnonzero(~(product + 1e-9 * (1 + product) < floor))  # what overflows is kept
        if not len(live):
            return
        narrow = self.bound.dtype == c.bound.dtype == np.float32
        slack = ((self.bound.shape[1] + 8) * 2.0**-22 if narrow else 1e-9) * (1 + most)
        maybe = ~(self.bound[live] @ c.bound.T < (floor[live] - slack).astype(np.float32 if narrow else np.float64)[:, None])
        own = np.flatnonzero(np.isin(c.ids, self.ids[live]))
        maybe[:, own] &= self.ids[live][:, None] != c.ids[own][None, :]
        if np.count_nonzero(maybe) > 0.05 * maybe.size:
            whole = products(self.rows[live], c.narrow if most < 1 << 24 else c.rows, most)
            maybe &= whole >= self.kth[live].astype(whole.dtype)[:, None]
            if np.count_nonzero(maybe) > 8 * k * len(live):  # at first, or many ties: what k others of the block surpass is out
                masked = np.where(maybe, whole, whole.dtype.type(LOW))
                maybe &= whole >= np.partition(masked, masked.shape[1] - k, axis=1)[:, [masked.shape[1] - k]]
            at, j = np.nonzero(maybe)
            s = whole[at, j].astype(np.int64)
        else:
            at, j = np.nonzero(maybe)
            if most < EXACT:
                s = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", self.rows[live[at[i : i + BLOCK]]].astype(np.float64), c.rows[j[i : i + BLOCK]]) for i in range(0, len(at), BLOCK))]).astype(np.int64)
            else:
                s = np.array([products(self.rows[live[[x]]], c.rows[[y]], most)[0, 0] for x, y in zip(at, j, strict=True)], np.int64)
        at, who = live[at], c.ids[j]
        better = (s > self.kth[at]) | ((s == self.kth[at]) & (who <= self.kid[at]))
        if better.any():
            self.keep(at[better], who[better], s[better])

    def keep(self, at: np.ndarray, who: np.ndarray, score: np.ndarray) -> None:
        k = self.score.shape[1]
        rows = np.unique(at)
        old = np.arange(k) < self.n[rows][:, None]
        q = np.concatenate([np.broadcast_to(rows[:, None], old.shape)[old], at])
        who, score = np.concatenate([self.who[rows][old], who]), np.concatenate([self.score[rows][old], score])
        order = np.lexsort((who, ~score, q))
        q, who, score = q[order], who[order], score[order]
        first = np.searchsorted(q, rows)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        best = rank < k
        self.who[q[best], rank[best]], self.score[q[best], rank[best]] = who[best], score[best]
        self.n[rows] = np.minimum(k, np.diff(np.append(first, len(q))))
        full = rows[self.n[rows] == k]
        s, w = self.score[full, -1], self.who[full, -1]
        nearer = (s > self.kth[full]) | ((s == self.kth[full]) & (w < self.kid[full]))
        self.kth[full[nearer]], self.kid[full[nearer]] = s[nearer], w[nearer]

    def found(self) -> pa.RecordBatch:
        got = np.arange(self.score.shape[1]) < self.n[:, None]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, self.n)), pa.array(self.who[got]), pa.array(self.score[got])], names=["query_id", "vec_id", "score"])


def packer(d: int, rows: int):
    """For mapInArrow over (vec_id, v): blocks of about `rows` rows, ids and integer coordinates as bytes."""

    def packed(batches):
        part, ids, mats, no = TaskContext.get().partitionId(), [], [], 0

        def block():
            i, m = np.concatenate(ids), np.concatenate(mats)
            cols = [pa.array([part], pa.int64()), pa.array([no], pa.int64()), pa.array([float(np.linalg.norm(m, axis=1).max())]), pa.array([i.tobytes()], pa.binary()), pa.array([stored(m)], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["part", "no", "longest", "ids", "rows"])

        for b in batches:
            for lo in range(0, b.num_rows, rows):
                s = b.slice(lo, rows)
                ids.append(s.column(0).to_numpy())
                mats.append(matrix(s.column(1), d))
                if sum(map(len, ids)) >= rows:
                    yield block()
                    ids, mats, no = [], [], no + 1
        if ids:
            yield block()

    return packed


def top_k(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query (a row whose vec_id is divisible by `every`)."""
    ints = stash(usable(vectors), "vectors")
    n, d = ints.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    d = max(1, d)
    turn = rotation(ints, d)
    head = max(1, d // 4)
    kind = "part long, no long, longest double, ids binary, rows binary"
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    ranges = min(RANGES, max(1, -(-n // RANGE)))
    dealt = ints.withColumn("len", length).repartitionByRange(ranges, F.col("len").desc(), "vec_id").sortWithinPartitions(F.col("len").desc(), "vec_id")
    blocks = stash(dealt.select("vec_id", "v").mapInArrow(packer(d, BLOCK), kind), "blocks")
    asked = ints.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asks = stash(asked.mapInArrow(packer(d, QUERIES), kind).select(F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows")), "asks")

    unstash(ints)

    # one block, at most about BLOCK rows; it is found by its numbers, as each task would send its own longest block
    name = blocks.select("part", "no", "longest").orderBy(F.col("longest").desc(), "part", "no").limit(1).collect()
    top = blocks.where((F.col("part") == name[0][0]) & (F.col("no") == name[0][1])).select("ids", "rows").collect() if name else []
    top_ids, top_rows = (bytes(top[0][0]), bytes(top[0][1])) if top else (b"", b"")

    def candidates(ids, rows) -> Block:
        i = np.frombuffer(ids, np.int64)
        return Block(i, loaded(rows, len(i), d) if len(i) else np.zeros((0, d)), turn, head, False)

    parts = blocks.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0] + 1
    step = F.floor(F.col("part") * F.lit(STEPS) / F.lit(parts))
    steps = blocks.groupBy(step.alias("step")).agg(F.max("longest"), F.max("part")).collect()  # at most STEPS rows
    reach, last = np.array([r[1] for r in steps], float), np.array([r[2] for r in steps], np.int64)

    def bounds(batches):
        """Each query's k-th score and id within the longest candidates, bounds of its k-th ones; and the last range that any query needs."""
        longest = candidates(top_ids, top_rows)
        for b in batches:
            floors, upto = [], []
            for r in b.to_pylist():
                ids = np.frombuffer(r["q_ids"], np.int64)
                q = Asked(ids, loaded(r["q_rows"], len(ids), d), turn, head, k)
                q.meet(longest)
                floors.append(np.concatenate([q.kth, q.kid]).tobytes())
                floor = np.where(q.kth == LOW, -np.inf, q.kth.astype(np.float64))
                reached = np.outer(q.norm, reach)
                needed = (~(reached + 1e-9 * (1 + reached) < floor[:, None])).any(axis=0)
                upto.append(int(last[needed].max(initial=-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(floors, pa.binary()), pa.array(upto, pa.int64())], names=["q_ids", "q_rows", "floor", "upto"])

    def scored(batches):
        """The k best of each query in each tile; rows are in order of tiles, and in a tile its queries come first."""
        tile, asked = None, []
        for b in batches:
            for t, ids, rows, floor in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3), strict=True):
                if t != tile:
                    yield from (q.found() for q in asked)
                    tile, asked = t, []
                if floor.is_valid:
                    i = np.frombuffer(ids.as_py(), np.int64)
                    asked.append(Asked(i, loaded(rows.as_py(), len(i), d), turn, head, k, np.frombuffer(floor.as_py(), np.int64).reshape(2, -1)))
                elif asked:
                    c = candidates(ids.as_buffer(), rows.as_buffer())
                    for q in asked:
                        q.meet(c)
        yield from (q.found() for q in asked)

    bounded = stash(asks.mapInArrow(bounds, "q_ids binary, q_rows binary, floor binary, upto long").where("upto >= 0"), "bounded")
    unstash(asks)
    held, width, far = bounded.agg(*[F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in ("q_ids", "q_rows")], F.coalesce(F.max("upto"), F.lit(-1))).first()
    groups = max(1, -(-(width + held // 8 * (4 * head + 20 * k + 64)) // GROUP_BYTES))
    sent = bounded.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("upto"))))
    sent = sent.select(F.col("part"), F.pmod(F.xxhash64("q_ids"), F.lit(groups)).alias("group"), F.lit(None).cast("double").alias("longest"), F.col("q_ids").alias("ids"), F.col("q_rows").alias("rows"), "floor")
    passing = blocks.where(F.col("part") <= far).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    both = sent.unionByName(passing.select("part", "group", "longest", "ids", "rows", F.lit(None).cast("binary").alias("floor")))
    tiles = both.select((F.col("part") * groups + F.col("group")).cast("int").alias("tile"), "ids", "rows", "floor", "longest").repartitionById(max(1, (far + 1) * groups), "tile")
    tiles = tiles.sortWithinPartitions("tile", F.col("longest").desc_nulls_first()).select("tile", "ids", "rows", "floor")
    found = tiles.mapInArrow(scored, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
