"""Sources: files with explicit schemas, vector caches with their check, id ranges, pages over HTTP."""

from __future__ import annotations

import time
import urllib.error
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The canonical article table.
ARTICLE = (
    "id string, url string, titlu string, data string, an int, luna string, sursa_site string, sectiune string, text_curat string, stire_citata string, naratiuni_false string, "
    "obiective_propaganda string, nr_cuvinte_v4 int, nr_cuvinte_truncat int, calitate_extractie string, label string, label_numeric int, hash_continut string"
)


def csv(spark: SparkSession, path: str, schema: str = ARTICLE, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header; only `columns` are parsed when given."""
    d = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return d.select(*columns) if columns else d


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; corrupt ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def page_files(spark: SparkSession, path: str) -> DataFrame:
    """A folder of .html files as (url, html)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(path).select(F.col("path").alias("url"), F.decode("content", "UTF-8").alias("html"))


def vector_cache(texts: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """texts (text) with the cached vector of their hash, and the texts that the cache lacks (to be encoded)."""
    keyed = texts.withColumn("text_hash", F.sha2("text", 256))
    return keyed.join(cache, "text_hash"), keyed.join(cache.select("text_hash"), "text_hash", "left_anti")


def id_range(spark: SparkSession, first: int, last: int) -> DataFrame:
    return spark.range(first, last + 1)


class HttpPages(DataSource):
    """Batch source "http_pages" (url, status, html): option urls, newline-separated; retries, backoff, pause.

    Each partition fetches its own urls in turn, so a run is as polite as `partitions` allows; 404 isn't retried.
    """

    @classmethod
    def name(cls) -> str:
        return "http_pages"

    def schema(self) -> str:
        return "url string, status int, html string"

    def reader(self, schema):
        return _HttpReader(self.options)


class _HttpReader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.n = max(1, int(options.get("partitions", "1")))
        self.tries, self.wait, self.pause = int(options.get("retries", "3")), float(options.get("backoff", "1")), float(options.get("pause", "0"))

    def partitions(self):
        return [InputPartition(self.urls[i :: self.n]) for i in range(min(self.n, max(1, len(self.urls))))]

    def read(self, partition):
        for url in partition.value:
            status, body = None, None
            for k in range(self.tries):
                try:
                    with urllib.request.urlopen(url, timeout=30) as r:
                        status, body = r.status, r.read().decode("utf-8", "replace")
                    break
                except urllib.error.HTTPError as e:
                    status = e.code
                    if e.code == 404:
                        break
                except OSError:
                    status = None
                time.sleep(self.wait * 2**k)
            yield url, status, body
            time.sleep(self.pause)
