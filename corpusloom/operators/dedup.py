"""Exact deduplication and set operations with an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, key: Column, *order: Column | str) -> DataFrame:
    """The first row of each key. A partial top-1 within tasks precedes the shuffle (window group limit)."""
    w = Window.partitionBy("_key").orderBy(*order)
    return rows.withColumn("_key", key).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_key", "_rn")


def repeats(rows: DataFrame, key: Column, sample: str) -> DataFrame:
    """Keys that occur more than once: how often, in how many sources, and a sample text."""
    g = rows.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_sources"), F.min(sample).alias("sample"))
    return g.where("n > 1")


def union_by_priority(parts: list[DataFrame]) -> DataFrame:
    """All rows with `priority` 0, 1, ... by the order of the parts; columns that a part lacks are null."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("priority", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that two tables share; not empty means contamination."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")


def check_disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    if overlap(a, b, key).take(1):
        raise ValueError(f"tables share values of {key}")


def check_complete(joined: DataFrame, column: str) -> DataFrame:
    """The rows of a left join, if every one of them found a partner."""
    missing = joined.where(F.col(column).isNull()).limit(3).collect()
    if missing:
        raise ValueError(f"rows without {column}, such as {missing}")
    return joined


def check_required(rows: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
