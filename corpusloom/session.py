"""Session factory and table loader."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def session(cpus: int | str = "*", app: str = "corpusloom", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", os.environ.get("SHUFFLE_PARTITIONS", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("DRIVER_MEMORY", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Arrow batches that Spark sends to Python, unless the session says otherwise than Spark's defaults.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def findable(spark: SparkSession) -> SparkSession:
    """Prepare a session for the Python operators: workers on this machine can import the package from this checkout
    (a cluster gets it by --py-files), and batches that Spark sends to Python are smaller than by default, as long texts
    would else fill an executor's memory outside its heap. Settings that the session has made itself stay.
    """
    root, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    for key, (default, ours) in BATCHES.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; Catalyst prunes columns and pushes filters into this scan."""
    findable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
