"""Top-1 and top-k cosine against a reference corpus, by blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a corpus that one block holds: 4096 vectors of 768 doubles are 25 MB.
BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def top_k(scored: DataFrame, k: int, *by: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "cid")
    return scored.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def top_k_blocked(queries: DataFrame, corpus: DataFrame, k: int = 1, *by: str, block: int = BLOCK) -> DataFrame:
    """(qid, *by, cid, score), the k best of each query (and corpus class), by matrix products of blocks.

    Both sides are dealt to blocks of about `block` rows, as many as their counts ask for; each pair of blocks is one task's
    group and yields k rows per query, so no pair of rows is ever a record. Memory is one block of each side.
    """
    n_q, n_c = (-(-d.count() // block) or 1 for d in (queries, corpus))
    q = queries.withColumn("x", F.pmod(F.xxhash64("qid"), F.lit(n_q)).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))))
    c = corpus.withColumn("y", F.pmod(F.xxhash64("cid"), F.lit(n_c)).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    kinds = {f.name: f.dataType.simpleString() for f in corpus.schema.fields}
    schema = ", ".join(["qid long", *[f"{b} {kinds[b]}" for b in by], "cid long", "score double"])
    names = ["qid", *by, "cid", "score"]

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            for at_class, part in right.groupby(list(by)) if by else [((), right)]:
                part = part.sort_values("cid")
                m, ids = np.stack(part["c"].to_numpy()).astype(float), part["cid"].to_numpy()
                for lo in range(0, len(left), 256):
                    some = left.iloc[lo : lo + 256]
                    s = np.stack(some["q"].to_numpy()).astype(float) @ m.T
                    at = np.argsort(-s, axis=1, kind="stable")[:, :k]
                    got = pd.DataFrame({"qid": np.repeat(some["qid"].to_numpy(), at.shape[1]), "cid": ids[at].ravel(), "score": np.take_along_axis(s, at, 1).ravel()})
                    out.append(got.assign(**dict(zip(by, at_class, strict=True)))[names])
        return pd.concat(out) if out else pd.DataFrame({n: [] for n in names})

    local = q.groupBy("x", "y").cogroup(c.groupBy("x", "y")).applyInPandas(best, schema)
    return top_k(local, k, "qid", *by).drop("rk")
