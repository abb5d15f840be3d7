"""Mixing sources to target weights by subset-sum budget fitting.

Sources, in code point order with null last, weigh 5, 2, 1, repeating, and share BUDGET times all words. A target
stops at LIMIT times its source's size; the excess is shared again by weight until no target is above. A
source takes each document once if its target allows (else none), and the rest of the target is a subset of
its documents: documents are counted by exact length, lengths are taken in proportion, longest first, up to a
remainder under SPAN words, and a bounded-knapsack dynamic programme over the counts that are left finds
the subset with that sum, or with the nearest. Which documents of a length are taken follows a seeded hash.

A source's table is its counts by length, never its documents; it is one row per distinct length. Ranks of
documents within (source, length) are counted in slices, so a hot source or a common length has no task of its own.

Cases: null or empty texts have size 0 and take nothing; a null source is a source of its own; repeated rows
count each; doc_ids may be null or repeated (only their hash is used); very long texts are one size like others, and
texts go through no shuffle; with no words at all every target is 0; columns with an output's name are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.ranking import ranked
from corpusloom.llm.shared import lookup, n_words, stash

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
LIMIT = 2
SPAN = 1 << 16
SEED = 20240


def targets(sizes: DataFrame) -> DataFrame:
    """sizes (has_source, source, source_size), a row for each source, with `target`.

    Sharing again ends with the same factor for all sources that don't stop; those that stop have the least
    LIMIT * size / weight. So they are a prefix of that order, and running sums find where it ends. Both windows
    run over one row per source.
    """
    by_name = Window.orderBy(F.col("has_source").desc(), "source")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    t = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", (F.lit(LIMIT) * F.col("source_size")).cast("double"))
    t = t.withColumn("budget", F.lit(BUDGET) * F.sum("source_size").over(Window.partitionBy()))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("has_source").desc(), "source")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    stopped, weighed = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    all_weights = F.sum("weight").over(Window.partitionBy())
    t = t.withColumn("factor", (F.col("budget") - stopped) / (all_weights - weighed))
    t = t.withColumn("place", F.row_number().over(by_cap)).withColumn("goes_on", F.when(F.col("cap") >= F.col("factor") * F.col("weight"), F.col("place")))
    t = t.withColumn("end", F.min("goes_on").over(Window.partitionBy()))
    t = t.withColumn("factor", F.coalesce(F.min(F.when(F.col("place") == F.col("end"), F.col("factor"))).over(Window.partitionBy()), F.lit(0.0)))
    t = t.withColumn("stops", F.col("end").isNull() | (F.col("place") < F.col("end")))
    return t.select("has_source", "source", "source_size", F.when(F.col("stops"), F.col("cap")).otherwise(F.col("factor") * F.col("weight")).alias("target"))


def subset(lengths: np.ndarray, counts: np.ndarray, goal: int) -> np.ndarray:
    """How many of each length to take for a sum of `goal`, or for the reachable sum nearest to it (the lower of equals)."""
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if goal <= 0 or not total:
        return take
    if goal >= total:
        return counts.copy()
    order = np.argsort(-lengths, kind="stable")
    share, owed = max(0.0, goal - SPAN / 2) / total, 0.0
    for i in order:
        n, c = int(lengths[i]), int(counts[i])
        owed += share * n * c
        take[i] = min(c, int(owed // n))
        owed -= n * int(take[i])
    rest = goal - int((lengths * take).sum())
    top = 2 * rest  # a sum over twice the rest is farther from it than none
    by = np.full(top + 1, -1, np.int32)  # by which item a sum is first reached
    by[0] = 0
    items: list[tuple[int, int]] = [(0, 0)]
    for i in order[::-1]:
        n, left, k = int(lengths[i]), int(min(counts[i] - take[i], top // lengths[i])), 1
        while left > 0 and by[rest] < 0:
            k2 = min(k, left)
            step = n * k2
            items.append((int(i), k2))
            new = np.flatnonzero((by[:-step] >= 0) & (by[step:] < 0)) + step
            by[new] = len(items) - 1
            left -= k2
            k *= 2
        if by[rest] >= 0:
            break
    reached = np.flatnonzero(by >= 0)
    at = int(reached[np.argmin(np.abs(reached - rest))])
    while at:
        i, k = items[by[at]]
        take[i] += k
        at -= k * int(lengths[i])
    return take


def plan(counts: DataFrame) -> DataFrame:
    """counts (has_source, source, size, n, source_size, target) to how many documents of a length are taken a further time."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        total, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        whole = min(LIMIT - 1, int(target // total)) if total else 0
        pdf = pdf.sort_values("size")
        take = subset(pdf["size"].to_numpy(), pdf["n"].to_numpy(), round(target - whole * total))
        return pdf.assign(whole=whole, more=take)[["has_source", "source", "size", "source_size", "target", "whole", "more"]]

    sized = counts.where("size > 0")
    return sized.groupBy("has_source", "source").applyInPandas(fit, "has_source boolean, source string, size long, source_size long, target double, whole long, more long")


#: What names a row whatever its ids: two hashes of all its columns. Rows with equal hashes are copies of one row.
ROW = ["_k1", "_k2"]


def row_keys(docs: DataFrame) -> list[Column]:
    return [F.xxhash64(F.lit(i), *docs.columns).alias(k) for i, k in enumerate(ROW)]


def planned(docs: DataFrame, keep: list, seed: int) -> DataFrame:
    """`keep` and has_source, source ('' for null), size, source_size, target, taken of each row of docs."""
    seeded = F.xxhash64(F.lit(seed), "doc_id", "text").alias("_seeded")
    rows = docs.select(*keep, n_words(F.col("text")).alias("size"), F.col("source").isNotNull().alias("has_source"), F.coalesce("source", F.lit("")).alias("source"), F.col("doc_id").alias("_id"), seeded)
    rows = stash(rows, "sizes")
    counts = stash(rows.groupBy("has_source", "source", "size").agg(F.count("*").alias("n")), "counts")
    goal = stash(targets(counts.groupBy("has_source", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))), "targets")
    plans = plan(counts.join(goal, ["has_source", "source"]))
    nothing = counts.where("size = 0").join(goal, ["has_source", "source"]).select("has_source", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("whole"), F.lit(0).cast("long").alias("more"))
    plans = stash(plans.unionByName(nothing), "plans")
    out = ranked(rows, ["size", "has_source", "source"], F.col("_seeded"), ["_id"], plans)
    copies = F.col("whole") + F.when(F.col("rank") < F.col("more"), 1).otherwise(0)
    return out.withColumn("taken", (copies * F.col("size")).cast("long")).drop("_id", "_seeded", "whole", "more", "rank")


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs with size, source_size, target and taken (the words that the mix takes of the document)."""
    new = {"size", "source_size", "target", "taken", "source", "text"}
    rest = [c for c in docs.columns if c.lower() not in new]
    own = [F.col(c).alias(f"_c{i}") for i, c in enumerate(rest)]  # no name of the input can clash
    source = F.when(F.col("has_source"), F.col("source")).alias("source")
    return planned(docs, own, seed).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(rest)], source, "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: rows of docs, once for each time that it takes them (whole documents).

    Decisions come back by ROW, so null and repeated ids mean nothing: of rows that agree in all columns
    one stands for all, as often as they are taken together.
    """
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0)
    wanted = planned(docs, row_keys(docs), seed).groupBy(*ROW).agg(F.sum(times).cast("long").alias("times"), F.count("*").alias("rows")).where("times > 0")
    wanted = stash(wanted.withColumn("n", F.col("rows")), "wanted")
    rows = lookup(docs.select(F.struct(*docs.columns).alias("_row"), *row_keys(docs)), wanted, ROW, "rows", "inner")
    out = rows.where("n = 1")
    if wanted.where("n > 1").take(1):
        out = out.unionByName(rows.where("n > 1").dropDuplicates(ROW))
    return out.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("_row.*")
