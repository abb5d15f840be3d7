"""Models: pluggable segmenter, encoder and classifier, a linear classifier trained here, and its explanations."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.registry import query
from corpusloom.session import table


class Encoder(Protocol):
    """Anything that maps texts to vectors; loaded once in each Python worker."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


def encode(d: DataFrame, make: type[Encoder], column: str = "text") -> DataFrame:
    """d with `embedding` (unit length): an iterator pandas_udf, so that a model is loaded once per worker."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for p in parts:
            v = np.asarray(model.encode(p.fillna("").tolist()), dtype=np.float32)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            yield pd.Series(list(v))

    return d.withColumn("embedding", run(column))


def mean_pool(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of token vectors under a mask, as sentence encoders pool."""
    m = mask[..., None].astype(float)
    return (tokens * m).sum(1) / np.maximum(m.sum(1), 1e-9)


class HashEncoder:
    """Hashed word counts as vectors: a stand-in where no neural model is installed."""

    size = 64

    def encode(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.size), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                out[i, zlib.crc32(w.encode()) % self.size] += 1
        return out


def classifier(features: int = 1 << 12) -> Pipeline:
    tok = RegexTokenizer(inputCol="text", outputCol="w", pattern=r"[^\x20\x09-\x0D]+", gaps=False, toLowercase=True)
    return Pipeline(stages=[tok, HashingTF(inputCol="w", outputCol="tf", numFeatures=features), IDF(inputCol="tf", outputCol="features"), LogisticRegression(labelCol="y", weightCol="weight", maxIter=20, regParam=0.01)])


def weighted(d: DataFrame) -> DataFrame:
    """Balanced class weights n / (2 n_c)."""
    c = d.groupBy("y").agg(F.count("*").alias("n_c"))
    n = c.agg(F.sum("n_c").alias("n"))
    return d.join(F.broadcast(c.crossJoin(n).select("y", (F.col("n") / (2.0 * F.col("n_c"))).alias("weight"))), "y")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("y"))
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(y, "doc_id")


def trained(spark: SparkSession, sf_dir: str) -> tuple[PipelineModel, DataFrame]:
    d = labelled(spark, sf_dir)
    return classifier().fit(weighted(d.where("doc_id % 5 <> 0"))), d


def truncated(d: DataFrame, limit: int = 256) -> DataFrame:
    """`truncated`: whether a text has more words than a classifier would read."""
    return d.withColumn("truncated", X.n_words(F.col("text")) > limit)


@query()
def logreg_fit_score(spark, sf_dir):
    """Train on four fifths of the labelled documents, score the others."""
    m, d = trained(spark, sf_dir)
    p = m.transform(truncated(d.where("doc_id % 5 = 0")))
    return p.select("doc_id", "y", F.round(vector_to_array("probability")[1], 6).alias("p1"), F.col("prediction").cast("int").alias("pred"), "truncated")


@query()
def linear_attribution(spark, sf_dir):
    """The 15 weightiest words of each held-out document under the linear model: count * idf * weight.

    For a linear model integrated gradients from the zero baseline, DeepLift and SHAP all equal this product.
    """
    m, d = trained(spark, sf_dir)
    words = d.where("doc_id % 5 = 0").select("doc_id", F.explode(X.words(F.lower("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    weight = spark.createDataFrame([(i, float(x)) for i, x in enumerate(np.asarray(m.stages[3].coefficients) * np.asarray(m.stages[2].idf))], "i int, w double")  # as many rows as features
    tf = HashingTF(inputCol="ws", outputCol="v", numFeatures=m.stages[1].getNumFeatures())
    index = F.array_position(vector_to_array("v"), 1.0).cast("int") - 1
    distinct = tf.transform(words.select("word").distinct().withColumn("ws", F.array("word"))).select("word", index.alias("i")).join(F.broadcast(weight), "i").drop("i")
    scored = words.join(distinct, "word").withColumn("attribution", F.round(F.col("n") * F.col("w"), 6))
    rk = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.abs("attribution").desc(), "word"))
    return scored.withColumn("rk", rk).where("rk <= 15").select("doc_id", "rk", "word", "attribution")


def lime(texts: DataFrame, score, perturbations: int = 1000, top: int = 15, seed: int = 42) -> DataFrame:
    """Local surrogate of a scoring function over words: (doc_id, word, weight).

    Each text is perturbed by dropping random words, scored, and fitted by ridge regression weighted with the
    closeness to the whole text. One text is a task's unit of work; texts are those to be explained, not a corpus.
    """

    def explain(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for doc_id, t in zip(p["doc_id"], p["text"], strict=True):
                ws = t.split()
                names = sorted(set(ws))
                if not names:
                    continue
                rng = np.random.default_rng(seed)
                keep = rng.random((perturbations, len(names))) < 0.5
                keep[0] = True
                at = {w: i for i, w in enumerate(names)}
                y = np.asarray(score([" ".join(w for w in ws if k[at[w]]) for k in keep]))
                near = np.exp(-((1 - keep.mean(1)) ** 2) / 0.25)
                x = np.hstack([keep, np.ones((len(keep), 1))])
                b = np.linalg.solve(x.T @ (near[:, None] * x) + np.eye(x.shape[1]), x.T @ (near * y))[:-1]
                best = np.argsort(-np.abs(b))[:top]
                yield pd.DataFrame({"doc_id": doc_id, "word": [names[i] for i in best], "weight": b[best]})

    return texts.select("doc_id", "text").mapInPandas(explain, "doc_id long, word string, weight double")


@query()
def lime_surrogate(spark, sf_dir):
    """The surrogate on the benchmark items, explaining the share of capital letters."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return lime(b, lambda ts: [sum(c.isupper() for c in t) / max(1, len(t)) for t in ts])


def word_attributions(tokens: DataFrame) -> DataFrame:
    """Token scores (doc_id, pos, token, score; a leading blank opens a word) summed to words."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    opens = ((F.col("pos") == 0) | F.col("token").startswith(" ")).cast("int")
    t = tokens.withColumn("k", F.sum(opens).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = t.groupBy("doc_id", "k").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("p"), F.sum("score").alias("score"))
    return g.select("doc_id", "k", F.trim(F.array_join(F.col("p.token"), "")).alias("word"), "score")


@query()
def encoded_documents(spark, sf_dir):
    """Documents as vectors of the stand-in encoder; a null or empty text has length 0."""
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), HashEncoder).select("doc_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x), 4).alias("length"))
