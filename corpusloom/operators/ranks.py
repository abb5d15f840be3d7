"""Ranks and running sums over groups that may hold all rows: counted by slices first, so no window has a whole group.

A slice is a value that grows with the order (a prefix of a hash, a day, a bucket of lengths). Rows are counted by group and
slice (within tasks first), a window over one row per slice gives each its offset, and the rest is a window over one slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, groups: list[str], slice_: Column, order: list[Column]) -> DataFrame:
    """rows with `rank` from 1 within `groups` by `order`, and `total`, the rows of the group. Null slices come last."""
    key = [*groups, "_slice"]
    rows = rows.withColumn("_slice", slice_)
    n = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*groups)
    before = F.coalesce(F.sum("_n").over(w.orderBy(F.col("_slice").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = n.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], before.alias("_before"), F.sum("_n").over(w).alias("total"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]
    local = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    out = rows.withColumn("_local", local).join(n, on)
    return out.withColumn("rank", F.col("_before") + F.col("_local")).drop("_slice", "_local", "_before", *[f"_k{i}" for i in range(len(key))])


#: Slices that a group's values are cut into.
CUTS = 64


def below(values: DataFrame, groups: list[str], value: str, sums: dict[str, str], upto: bool = False) -> DataFrame:
    """values (one row per group and value) with running sums: sums[new] = column summed over lesser values (`upto`: and the row's own).

    Slices end at approximate quantiles, so they are about equal whatever the distribution.
    """
    q = F.percentile_approx(value, F.array(*[F.lit((i + 1) / CUTS) for i in range(CUTS - 1)]), 1000)
    cuts = values.groupBy(*groups).agg(q.alias("_q"))
    join = values.join(F.broadcast(cuts), groups) if groups else values.crossJoin(F.broadcast(cuts))
    rows = join.withColumn("_slice", F.size(F.filter("_q", lambda x: x < F.col(value)))).drop("_q")
    key = [*groups, "_slice"]
    w = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    part = rows.groupBy(*key).agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    part = part.select(*key, *[F.coalesce(F.sum(f"_s_{n}").over(w), F.lit(0)).alias(f"_b_{n}") for n in sums])
    local = Window.partitionBy(*key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0 if upto else -1)
    out = rows.withColumns({f"_l_{n}": F.coalesce(F.sum(c).over(local), F.lit(0)) for n, c in sums.items()}).join(F.broadcast(part), key)
    return out.withColumns({n: F.col(f"_b_{n}") + F.col(f"_l_{n}") for n in sums}).drop("_slice", *[f"_{x}_{n}" for n in sums for x in "bl"])
