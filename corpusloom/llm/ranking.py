"""Ranks within groups of which one may hold a third of all rows: counted in slices, without a task for a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 1024


def ranked(rows: DataFrame, group: list[str], order: Column, ties: list[str], extra: DataFrame | None = None) -> DataFrame:
    """rows (a stored table) with `rank`, from 0 within `group`, by the 64-bit value `order`, then by `ties`.

    The values are cut into SLICES ranges. Rows are counted by group and range (within tasks first); a running sum
    over a group's at most SLICES counts gives each range its first rank; the rest is a window over one range of
    one group. `order` should be spread evenly, as a hash is. Group columns have no nulls; a string comes last. `extra` (a row for each group) joins those counts.
    """
    width = (1 << 64) // SLICES
    cut = F.floor((order / F.lit(float(width))) + F.lit(SLICES / 2.0)).cast("int")
    cut = F.greatest(F.lit(0), F.least(cut, F.lit(SLICES - 1)))
    rows = rows.withColumn("_order", order).withColumn("_slice", cut)
    counts = rows.groupBy(*group, "_slice").agg(F.count("*").alias("_n"))
    start = F.sum("_n").over(Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("_start", F.coalesce(start, F.lit(0))).drop("_n")
    if extra is not None:
        counts = counts.join(extra, group, "left")
    # one column for range and group: on several, Spark would deal the rows by those of the group alone
    cell = F.concat_ws("|", "_slice", *[F.col(c).cast("string") for c in group])
    counts = counts.withColumn("_cell", cell).drop(*group, "_slice")
    local = F.row_number().over(Window.partitionBy("_cell").orderBy("_order", *ties)) - 1
    out = rows.withColumn("_cell", cell).withColumn("_local", local).join(counts, "_cell", "left")
    return out.withColumn("rank", (F.col("_start") + F.col("_local")).cast("long")).drop("_order", "_slice", "_local", "_start", "_cell")
