"""Table functions: one value in, rows out, callable in SQL after registration."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


@F.udtf(returnType="pos int, piece string")
class WordWindows:
    """The runs of n words of a text, by position; none for null or shorter texts."""

    def eval(self, text: str, n: int):
        ws = (text or "").split()
        for i in range(len(ws) - n + 1):
            yield i, " ".join(ws[i : i + n])


def register(spark: SparkSession) -> None:
    spark.udtf.register("word_windows", WordWindows)
