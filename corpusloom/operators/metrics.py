"""Confusion metrics, ranks and two-sample statistics as aggregates; doubles throughout, null where undefined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions.scoring import kolmogorov, ratio, two_sided
from corpusloom.operators.ranks import below


def confusion(rows: DataFrame, *by: str) -> DataFrame:
    """tp, fp, fn, tn of columns y and pred."""
    cell = lambda y, p: F.count_if((F.col("y") == y) & (F.col("pred") == p))
    return rows.groupBy(*by).agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))


def rates(c: DataFrame) -> DataFrame:
    """accuracy, precision, recall and f1 of a confusion table; 0 where a denominator is."""
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.withColumns({"accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def average_rank(value: str, *by: str) -> Column:
    """Rank from 1 with ties averaged. Global ranks need a sort of their partition; scale by passing groups."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / F.lit(2.0)


def auc(rows: DataFrame, *by: str) -> DataFrame:
    """Area under the ROC curve of `score` for label y, by rank sums over distinct values (ties averaged).

    Rows are first counted by value, and running sums go by slices of the values (operators.ranks).
    """
    n = rows.groupBy(*by, "score").agg(F.count_if(F.col("y") == 1).cast("double").alias("n1"), F.count_if(F.col("y") == 0).cast("double").alias("n0"))
    wins = below(n, list(by), "score", {"b": "n0"})
    g = wins.groupBy(*by).agg(F.sum(F.col("n1") * (F.col("b") + F.col("n0") / 2)).alias("u"), F.sum("n1").alias("p"), F.sum("n0").alias("q"))
    return g.select(*by, F.try_divide(F.col("u"), F.col("p") * F.col("q")).alias("auc"))


def cohen_d(rows: DataFrame, *by: str, sample: bool = True) -> DataFrame:
    """(mean 1 - mean 0) / pooled standard deviation; ddof 1, or 0 with sample=False."""
    var = F.var_samp if sample else F.var_pop
    of = lambda f, y: f(F.when(F.col("y") == y, F.col("score")))
    g = rows.groupBy(*by).agg(of(F.avg, 1).alias("m1"), of(F.avg, 0).alias("m0"), of(var, 1).alias("v1"), of(var, 0).alias("v0"), F.count_if(F.col("y") == 1).alias("n1"), F.count_if(F.col("y") == 0).alias("n0"))
    less = 1 if sample else 0
    pooled = F.sqrt(F.try_divide((F.col("n1") - less) * F.col("v1") + (F.col("n0") - less) * F.col("v0"), (F.col("n1") + F.col("n0") - 2 * less).cast("double")))
    return g.select(*by, F.try_divide(F.col("m1") - F.col("m0"), pooled).alias("cohen_d"))


def ks(rows: DataFrame, *by: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance of `score` between labels."""
    n = rows.groupBy(*by, "score").agg(F.count_if(F.col("y") == 1).cast("double").alias("n1"), F.count_if(F.col("y") == 0).cast("double").alias("n0"))
    n = below(n, list(by), "score", {"c1": "n1", "c0": "n0"}, upto=True)
    all_ = n.groupBy(*by).agg(F.sum("n1").alias("a1"), F.sum("n0").alias("a0"))
    n = n.join(F.broadcast(all_), list(by)) if by else n.crossJoin(F.broadcast(all_))
    gap = F.abs(F.try_divide(F.col("c1"), F.col("a1")) - F.try_divide(F.col("c0"), F.col("a0")))
    return n.withColumn("gap", gap).groupBy(*by).agg(F.max("gap").alias("ks"), F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def pearson(x: str, y: Column) -> Column:
    """Correlation; null where a side doesn't vary."""
    return F.try_divide(F.covar_pop(F.col(x).cast("double"), y), F.stddev_pop(x) * F.stddev_pop(y))


def describe(rows: DataFrame, value: str, *by: str) -> DataFrame:
    p = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = rows.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("min"), p.alias("p"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return g.select(*by, "n", "min", *[F.col("p")[i].alias(a) for i, a in enumerate(("p25", "median", "p75"))], "max", "mean", "std")


def rank_sum(rows: DataFrame) -> DataFrame:
    """Mann-Whitney test of `score` between labels, two-sided: (u, z, p), ties corrected and with continuity correction."""
    n = rows.groupBy("score").agg(F.count_if(F.col("y") == 1).cast("double").alias("a"), F.count_if(F.col("y") == 0).cast("double").alias("b"))
    t = F.col("a") + F.col("b")
    s = below(n, [], "score", {"less": "b"}).agg(F.sum(F.col("a") * (F.col("less") + F.col("b") / 2)).alias("u1"), F.sum("a").alias("n1"), F.sum("b").alias("n0"), F.sum(t * t * t - t).alias("ties"))
    n1, n0, all_ = F.col("n1"), F.col("n0"), F.col("n1") + F.col("n0")
    spread = F.sqrt(n1 * n0 / 12 * (all_ + 1 - F.try_divide(F.col("ties"), all_ * (all_ - 1))))
    s = s.withColumn("u", F.greatest(F.col("u1"), n1 * n0 - F.col("u1"))).withColumn("z", F.try_divide(F.col("u") - n1 * n0 / 2 - 0.5, spread))
    return s.select(F.col("u1").alias("u"), "z", F.when(F.col("z") < 0, 1.0).otherwise(two_sided(F.col("z"))).alias("p"))


def signed_rank(rows: DataFrame) -> DataFrame:
    """Wilcoxon test of paired differences `d` (zeros left out), two-sided: (w, z, p), ties corrected."""
    n = rows.where("d <> 0").withColumn("m", F.abs("d")).groupBy("m").agg(F.count_if(F.col("d") > 0).cast("double").alias("up"), F.count_if(F.col("d") < 0).cast("double").alias("down"))
    n = below(n.withColumn("t", F.col("up") + F.col("down")), [], "m", {"less": "t"})
    t, rank = F.col("t"), F.col("less") + (F.col("t") + 1) / 2
    s = n.agg(F.sum(F.col("up") * rank).alias("plus"), F.sum(F.col("down") * rank).alias("minus"), F.sum(t).alias("n"), F.sum(t * t * t - t).alias("ties"))
    k = F.col("n")
    spread = F.sqrt((k * (k + 1) * (2 * k + 1) - F.col("ties") / 2) / 24)
    s = s.withColumn("w", F.least("plus", "minus")).withColumn("z", F.try_divide(F.col("w") - k * (k + 1) / 4, spread))
    return s.select("w", "z", two_sided(F.col("z")).alias("p"))


def ks_test(rows: DataFrame, *by: str) -> DataFrame:
    """The Kolmogorov-Smirnov distance with its limiting probability: (*by, ks, p)."""
    scaled = F.col("ks") * F.sqrt(F.try_divide(F.col("n1") * F.col("n0"), F.col("n1") + F.col("n0")))
    return ks(rows, *by).select(*by, "ks", kolmogorov(scaled).alias("p"))


def faithfulness(d: DataFrame, ranked: Column, score, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """d (with `text`) with drop_k, what a score loses when the k weightiest words are deleted, and `auc`, their mean.

    `ranked` lists words by falling weight; a drop is null where there are fewer than k or nothing is left, and without any drop auc is 0.
    """
    text = F.col("text")
    rest = lambda k: X.without_words(text, F.transform(F.slice(ranked, 1, k), F.lower))
    d = d.withColumns({f"_rest{k}": rest(k) for k in ks})
    d = d.withColumns({f"drop_{k}": F.when((F.size(ranked) >= k) & (F.trim(f"_rest{k}") != ""), score(text) - score(F.col(f"_rest{k}"))) for k in ks})
    valid = F.filter(F.array(*[f"drop_{k}" for k in ks]), lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(valid, F.lit(0.0), lambda a, x: a + x), F.size(valid))
    return d.withColumn("auc", F.coalesce(mean, F.lit(0.0))).drop(*[f"_rest{k}" for k in ks])
