"""Deterministic sampling: a rank by md5 of seed and key replaces a random stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.ranks import numbered


def drawn(key: str, seed: int = 42) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def stratified(rows: DataFrame, strata: list[str], quota: int | Column, key: str, seed: int = 42) -> DataFrame:
    """Up to quota rows of each stratum."""
    w = Window.partitionBy(*strata).orderBy(drawn(key, seed), key)
    return rows.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= quota)


def downsample(rows: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    return rows.orderBy(drawn(key, seed), key).limit(n)


def by_draw(rows: DataFrame, strata: list[str], key: str, seed: int = 42) -> DataFrame:
    """rows with `rank` within strata in drawn order and `total`: counted by the draw's first digits, so a stratum is no task."""
    out = rows.withColumn("_drawn", drawn(key, seed))
    return numbered(out, strata, F.substring("_drawn", 1, 3), [F.col("_drawn"), F.col(key)]).drop("_drawn")


def folds(rows: DataFrame, strata: list[str], k: int, key: str, seed: int = 42) -> DataFrame:
    """Fold 0..k-1 of each row, even within strata."""
    return by_draw(rows, strata, key, seed).withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("rank", "total")


def split(rows: DataFrame, strata: list[str], key: str, train: float = 0.7, val: float = 0.15, seed: int = 42) -> DataFrame:
    """`part` train, val or test by rank within the stratum."""
    out = by_draw(rows, strata, key, seed).withColumnsRenamed({"rank": "_r", "total": "_n"})
    part = F.when(F.col("_r") <= F.floor(F.col("_n") * train + 0.5), "train").when(F.col("_r") <= F.floor(F.col("_n") * train + 0.5) + F.floor(F.col("_n") * val + 0.5), "val").otherwise("test")
    return out.withColumn("part", part).drop("_r", "_n")


def month_quotas(pools: DataFrame, target: int) -> DataFrame:
    """pools (month, n) -> quota: an equal share each, the remainder to the largest pools, capped by the pool.

    What a cap frees goes, in three rounds, to the largest pools that still have rows. The table has a row per
    month, so its windows are small whatever the data.
    """
    one = Window.partitionBy()
    t = pools.withColumn("quota", F.lit(0).cast("long"))
    for _ in range(4):
        t = t.withColumn("room", F.col("n") - F.col("quota"))
        t = t.withColumn("open", (F.col("room") > 0).cast("long"))
        t = t.withColumn("owed", F.lit(target) - F.sum("quota").over(one)).withColumn("k", F.sum("open").over(one))
        rank = F.row_number().over(Window.partitionBy("open").orderBy(F.desc("n"), "month"))
        share = F.when(F.col("k") > 0, F.floor(F.col("owed") / F.col("k")) + F.when(rank <= F.col("owed") % F.col("k"), 1).otherwise(0)).otherwise(0)
        t = t.withColumn("quota", F.when(F.col("open") == 1, F.col("quota") + F.least("room", share)).otherwise(F.col("quota")).cast("long")).drop("room", "open", "owed", "k")
    return t
