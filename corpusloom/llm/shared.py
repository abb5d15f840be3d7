"""What several operators of this subpackage need: stored intermediate tables and joins that survive hot keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: ASCII white space only. A word is a longest run of other characters.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (unset, in a local session) a folder of our own."""
    d = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("corpusloom.shared.dir", "")
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("corpusloom.shared.dir", d)
    return d.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone when the interpreter ends
        pass


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        _remove(spark, path)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def unstash(*dfs: DataFrame) -> None:
    """Delete stored tables that no later step reads."""
    for df in dfs:
        path = getattr(df, "stash_path", None)
        if path:
            _remove(df.sparkSession, path)


def n_words(text: Column) -> Column:
    """Words of a text, on the JVM; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Rows of at most some tens of bytes that may be broadcast, after they have been counted; more are dealt by key.
SMALL_ROWS = 250_000
#: A key with over 1 / HEAVY of the rows is heavy, so there are fewer than HEAVY such keys, whatever the size.
HEAVY = 1000


def lookup(big: DataFrame, small: DataFrame, keys: list[str], rows: str, how: str = "left", total: int | None = None, most: int | None = None) -> DataFrame:
    """big joined with small, which has each key once and how many rows of big the key has, in column `rows`.

    Fewer than HEAVY keys can each have over 1/HEAVY of big's rows: those few are broadcast (a bound that
    doesn't grow with the data), so that no task gets all rows of a hot key. The others are dealt by key. A small table of
    at most SMALL_ROWS rows (counted) is broadcast whole.
    `total`: the rows of big, `most`: a bound of the rows of small, if known. small should be a stored table: it is read twice. Column `rows` is dropped.
    """
    if most is not None and most <= SMALL_ROWS:
        return big.join(F.broadcast(small.drop(rows)), keys, how)
    n, seen = small.agg(F.count("*"), F.coalesce(F.sum(rows), F.lit(0))).first()
    if n <= SMALL_ROWS:
        return big.join(F.broadcast(small.drop(rows)), keys, how)
    least = max(2, (seen if total is None else total) // HEAVY + 1)
    heavy = small.where(F.col(rows) >= least).drop(rows)
    names = [r for r in heavy.take(1)]
    if not names:
        return big.join(small.drop(rows), keys, how)
    flag = F.broadcast(heavy.select(*keys).withColumn("_hot", F.lit(True)))
    marked = big.join(flag, keys, "left")
    light = marked.where(F.col("_hot").isNull()).drop("_hot").join(small.where(F.col(rows) < least).drop(rows), keys, how)
    hot = marked.where(F.col("_hot").isNotNull()).drop("_hot").join(F.broadcast(heavy), keys, "inner")
    return light.unionByName(hot)


def small_side(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """df, for broadcast if it has at most `limit` rows (they are counted); else for Spark's ordinary joins."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
