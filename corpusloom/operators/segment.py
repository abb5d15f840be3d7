"""Articles to sentences and filters on sentence length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import n_chars, n_words


def sentences(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per sentence (doc_id, *keep, pos, sentence, n_words, n_chars); pos from 0, blank pieces left out.

    A sentence ends at an end mark followed by white space, or at a line end. No lookbehind, so that the rule
    reads the same in other engines. A model-backed segmenter can replace it as an iterator pandas_udf.
    """
    pieces = F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\u0001"), "\u0001|\n+")
    out = docs.select("doc_id", *keep, F.posexplode(pieces).alias("pos", "sentence")).where(F.trim("sentence") != "")
    return out.withColumn("n_words", n_words(F.col("sentence"))).withColumn("n_chars", n_chars(F.col("sentence")))


def between_words(rows: DataFrame, low: int = 7, high: int = 54) -> DataFrame:
    return rows.where(F.col("n_words").between(low, high))


def between_percentiles(rows: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Rows within the two percentiles (interpolated, cut to integers) of their own lengths; the bounds are one row."""
    p = rows.agg(F.percentile("n_words", F.array(F.lit(low), F.lit(high))).alias("p")).select(F.col("p")[0].cast("int").alias("p_low"), F.col("p")[1].cast("int").alias("p_high"))
    return rows.join(F.broadcast(p), F.col("n_words").between(F.col("p_low"), F.col("p_high")))
