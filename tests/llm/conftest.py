import os
import random

import pytest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture
def rng():
    return random.Random(5)


def docs_frame(spark, texts, extra=False):
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, cols)
    if extra:
        from pyspark.sql import functions as F

        for c in ("n_words", "kept", "score", "size", "rank", "component_id"):
            d = d.withColumn(c, F.lit("x"))
    return d


EDGES = ["", None, " \n\t", "one", "a b c d", "w " * 3000, "same line\nsame line\nsame line", "ünï çødé ☃ 日本"]
