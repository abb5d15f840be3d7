"""Streaming queries, run over the events that are there; their batch twins are in table_queries."""

from __future__ import annotations

import uuid

from corpusloom.registry import query
from corpusloom.session import table
from corpusloom.streaming import events


def _checkpoint(spark) -> str:
    d = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        d = tempfile.mkdtemp(prefix="stream-")
    return f"{d.rstrip('/')}/stream/{uuid.uuid4().hex}"


def _source(spark, sf_dir):
    table(spark, sf_dir, "events")
    return events.source(spark, f"{sf_dir}/events.parquet*")


_HOURS = "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2"


@query(_HOURS)
def stream_windows(spark, sf_dir):
    return events.run_to_table(events.windows(_source(spark, sf_dir)), f"w_{uuid.uuid4().hex}", _checkpoint(spark))


@query("select user_id, count(*) as n, round(sum(value), 4) as total from events group by 1")
def stream_totals(spark, sf_dir):
    from pyspark.sql import functions as F

    t = events.run_to_table(events.running_totals(_source(spark, sf_dir)), f"t_{uuid.uuid4().hex}", _checkpoint(spark), "update")
    return t.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 4).alias("total"))


@query("select user_id, event_type from events group by 1, 2")
def stream_first_seen(spark, sf_dir):
    s = events.first_seen(_source(spark, sf_dir), ["user_id", "event_type"], "60 days")
    return events.run_to_table(s.select("user_id", "event_type"), f"f_{uuid.uuid4().hex}", _checkpoint(spark), "append")


@query("""with o as (select user_id, ts, (lag(ts) over (partition by user_id order by ts) is null or ts - lag(ts) over (partition by user_id order by ts) >= interval 30 minutes)::int as o from events), s as (select *, sum(o) over (partition by user_id order by ts rows unbounded preceding) as k from o)
select user_id, min(ts) as start, count(*) as n from s group by user_id, k""")
def stream_sessions(spark, sf_dir):
    return events.run_to_table(events.sessions(_source(spark, sf_dir)), f"s_{uuid.uuid4().hex}", _checkpoint(spark))


@query("""with w as (select event_type, value, time_bucket(interval 30 minutes, ts) - k * interval 30 minutes as start from events, range(0, 2) r(k)) select start, event_type, count(*) as n, round(sum(value), 4) as total from w group by 1, 2""")
def stream_sliding(spark, sf_dir):
    """Windows of an hour that begin every half hour: each event counts in two."""
    return events.run_to_table(events.windows(_source(spark, sf_dir), slide="30 minutes"), f"l_{uuid.uuid4().hex}", _checkpoint(spark))
