"""Queries for sampling, set operations, time coverage, relational operators and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import dedup, html, ranks, sampling
from corpusloom.plans.text_queries import _PLAIN, _drop_sql
from corpusloom.registry import query
from corpusloom.session import table

_MD5 = "md5('42|' || doc_id)"
_VISIBLE = _PLAIN.format(_drop_sql("html"))


# ---- sampling

@query(f"select doc_id, lang, source, rk::int as rk from (select *, row_number() over (partition by lang, source order by {_MD5}, doc_id) as rk from documents) where rk <= 3")
def stratified_sample(spark, sf_dir):
    return sampling.stratified(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang", "source"], 3, "doc_id")


@query(f"select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by {_MD5}, doc_id) as rk, count(*) over (partition by lang) as n, count(*) over () as t from documents) where rk <= round(100.0 * n / t)")
def quota_sample(spark, sf_dir):
    """100 rows dealt to languages in proportion."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    q = d.groupBy("lang").agg(F.count("*").alias("n")).withColumn("q", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy())))
    return sampling.stratified(d.join(q, "lang"), ["lang"], F.col("q"), "doc_id").select("doc_id", "lang")


@query(f"select doc_id from documents order by {_MD5}, doc_id limit 100")
def hash_downsample(spark, sf_dir):
    return sampling.downsample(table(spark, sf_dir, "documents").select("doc_id"), 100, "doc_id")


@query(f"""with s as (select doc_id, quality, source, row_number() over (partition by quality, source order by {_MD5}, doc_id) as r, count(*) over (partition by quality, source) as n from labels join documents using (doc_id))
select doc_id, quality, source, case when r <= floor(n * 0.7::double + 0.5) then 'train' when r <= floor(n * 0.7::double + 0.5) + floor(n * 0.15::double + 0.5) then 'val' else 'test' end as part from s""")
def split_70_15_15(spark, sf_dir):
    """Train, validation and test rows, even within label and source."""
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return sampling.split(rows, ["quality", "source"], "doc_id")


@query(f"""with b as (select doc_id, n_chars, case when n_chars < 200 then 'a' when n_chars < 600 then 'b' when n_chars < 1200 then 'c' when n_chars < 2400 then 'd' else 'e' end as bucket from documents)
select doc_id, bucket from (select *, row_number() over (partition by bucket order by {_MD5}, doc_id) as rk from b) where rk <= 15""")
def length_bucket_sample(spark, sf_dir):
    n = F.col("n_chars")
    b = table(spark, sf_dir, "documents").select("doc_id", F.when(n < 200, "a").when(n < 600, "b").when(n < 1200, "c").when(n < 2400, "d").otherwise("e").alias("bucket"))
    return sampling.stratified(b, ["bucket"], 15, "doc_id").select("doc_id", "bucket")


@query("""with b as (select page_id, least(page_id // (select greatest(max(page_id) // 11, 1) from pages), 10) as bucket from pages) select page_id, bucket from (select *, row_number() over (partition by bucket order by md5('42|' || page_id), page_id) as rk from b) where rk <= 4""")
def page_bucket_sample(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id")
    size = p.agg(F.greatest(F.floor(F.max("page_id") / 11), F.lit(1)).alias("size"))
    b = p.crossJoin(F.broadcast(size)).select("page_id", F.least(F.floor(F.col("page_id") / F.col("size")), F.lit(10).cast("long")).alias("bucket"))
    return sampling.stratified(b, ["bucket"], 4, "page_id").select("page_id", "bucket")


@query("select doc_id, source from (select doc_id, source, i, row_number() over (order by i, source) as k from (select doc_id, source, row_number() over (partition by source order by doc_id) as i from documents)) where k <= 50")
def round_robin_quota(spark, sf_dir):
    """50 rows taken from the sources in turn."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    d = d.withColumn("i", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("i <= 50")
    return d.orderBy("i", "source").limit(50).select("doc_id", "source")


@query("""with m as (select strftime(o_orderdate, '%Y-%m') as month, count(*) as n from orders group by 1), k as (select count(*) as k from m), r as (select *, row_number() over (order by n desc, month) as rk from m)
select month, n, least(n, 60 // k + (rk <= 60 % k)::int)::bigint as quota from r, k where k <= 60 union all select month, n, (rk <= 60)::bigint from r, k where k > 60""")
def month_quota(spark, sf_dir):
    m = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return sampling.month_quotas(m, 60)


@query("select doc_id, lang, n_chars, pos from (select doc_id, lang, n_chars, row_number() over (partition by lang order by n_chars, doc_id) as r, count(*) over (partition by lang) as n from documents) join (values ('first'), ('middle'), ('last')) v(pos) on r = case pos when 'first' then 1 when 'middle' then n // 2 + 1 else n end")
def group_picks(spark, sf_dir):
    """First, middle and last row of each group by a score."""
    d = ranks.numbered(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), ["lang"], F.floor(F.col("n_chars") / 16), [F.col("n_chars"), F.col("doc_id")])
    d = d.withColumnRenamed("rank", "r").withColumnRenamed("total", "n")
    at = {"first": F.lit(1), "middle": F.floor(F.col("n") / 2) + 1, "last": F.col("n")}
    return d.withColumn("pos", F.explode(F.filter(F.array(*[F.when(F.col("r") == v, F.lit(k)) for k, v in at.items()]), lambda x: x.isNotNull()))).select("doc_id", "lang", "n_chars", "pos")


# ---- set operations

@query(f"""with u as (select doc_id, text, 0 as priority from documents union all select item_id, text, 1 from benchmark union all select page_id, {_VISIBLE}, 2 from pages)
select doc_id, priority, sha1(text) as key from (select *, row_number() over (partition by sha1(text) order by priority, doc_id) as rn from u) where rn = 1""")
def merge_priority_dedup(spark, sf_dir):
    """Whole tables merged: of equal texts the one of the first table (documents, benchmark, pages) and least id."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), html.visible_text(F.col("html")).alias("text"))
    u = dedup.union_by_priority([d, b, p]).withColumn("key", F.sha1("text"))
    return dedup.keep_first(u.drop("text"), F.col("key"), "priority", "doc_id").select("doc_id", "priority", "key")


@query("select doc_id, lang, source, null::varchar as url, 0 as priority from documents union all select page_id, null, null, url, 1 from pages")
def schema_union(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return dedup.union_by_priority([d, table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")]).select("doc_id", "lang", "source", "url", "priority")


@query("select doc_id, source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def resume_antijoin(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query(f"select d.doc_id, d.lang from documents d where d.doc_id not in (select doc_id from (select doc_id, row_number() over (order by {_MD5}, doc_id) as r from labels) where r <= 50)")
def corpus_minus_val(spark, sf_dir):
    val = sampling.downsample(table(spark, sf_dir, "labels").select("doc_id"), 50, "doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(val, "doc_id", "left_anti")


@query("select (select count(*) from (select doc_id from documents intersect select doc_id from labels)) as n_both, (select count(*) from (select doc_id from documents except select doc_id from labels)) as n_documents_only, (select count(*) from (select doc_id from labels except select doc_id from documents)) as n_labels_only")
def key_sets(spark, sf_dir):
    d, x = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("d")).distinct(), table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("l")).distinct()
    j = d.join(x, "doc_id", "full")  # one shuffle for the three counts
    return j.agg(F.count_if(F.col("d").isNotNull() & F.col("l").isNotNull()).alias("n_both"), F.count_if(F.col("l").isNull()).alias("n_documents_only"), F.count_if(F.col("d").isNull()).alias("n_labels_only"))


@query("select coalesce(a.lang, b.lang) as lang, coalesce(a.n, 0) as n_short, coalesce(b.n, 0) as n_long from (select lang, count(*) as n from documents where n_chars < 300 group by lang) a full join (select lang, count(*) as n from documents where n_chars > 5000 group by lang) b on a.lang = b.lang")
def count_alignment(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", "n_chars")
    return d.groupBy("lang").agg(F.count_if(F.col("n_chars") < 300).alias("n_short"), F.count_if(F.col("n_chars") > 5000).alias("n_long")).where("n_short > 0 or n_long > 0")


@query("select d.doc_id, d.source, l.quality, l.toxic, (l.doc_id is null) as missing from documents d left join labels l on l.doc_id = d.doc_id")
def left_join_complete(spark, sf_dir):
    x = table(spark, sf_dir, "labels").withColumn("_seen", F.lit(True))
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(x, "doc_id", "left").withColumn("missing", F.col("_seen").isNull()).drop("_seen")


@query("select 'ord_' || lpad((row_number() over (order by o_orderdate nulls last, o_orderkey) - 1)::varchar, 6, '0') as new_id, o_orderkey from orders ")
def stable_ids(spark, sf_dir):
    """Numbered ids in date order, over all orders: ranks are counted by day, so no window has more than a day's rows."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").withColumn("day", F.to_date("o_orderdate"))
    o = ranks.numbered(o, [], F.col("day"), [F.col("o_orderdate").asc_nulls_last(), F.col("o_orderkey")])
    return o.select(F.concat(F.lit("ord_"), F.lpad((F.col("rank") - 1).cast("string"), 6, "0")).alias("new_id"), "o_orderkey")


# ---- coverage and cross tables

@query("""with c as (select strftime(ts, '%Y-%m-%d') as day, count(*) as n from events where event_type = 'error' group by 1), d as (select strftime(x, '%Y-%m-%d') as day from generate_series((select min(date_trunc('day', ts)) from events), (select max(date_trunc('day', ts)) from events), interval 1 day) t(x))
select d.day, coalesce(c.n, 0) as n, c.n is null as gap from d left join c on c.day = d.day""")
def coverage_gaps(spark, sf_dir):
    """Counts per period with the empty periods in between."""
    e = table(spark, sf_dir, "events")
    days = e.agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b")).select(F.explode(F.transform(F.sequence("a", "b"), lambda x: F.date_format(x, "yyyy-MM-dd"))).alias("day"))
    c = e.where("event_type = 'error'").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return days.join(c, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("gap"))


@query("""with a as (select year(o_orderdate) as y, 100.0::double * count(*) / sum(count(*)) over () as p from orders where o_orderstatus = 'F' group by 1), b as (select year(o_orderdate) as y, 100.0::double * count(*) / sum(count(*)) over () as p from orders where o_orderstatus <> 'F' group by 1)
select coalesce(a.y, b.y)::int as y, round(coalesce(a.p, 0) - coalesce(b.p, 0), 6) as diff, abs(coalesce(a.p, 0) - coalesce(b.p, 0)) > 15 as flagged from a full join b on a.y = b.y""")
def year_share_mismatch(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("a"), F.count_if(F.col("o_orderstatus") != "F").alias("b"))
    share = lambda c: F.coalesce(F.lit(100.0) * F.col(c) / F.sum(c).over(Window.partitionBy()), F.lit(0.0))
    o = o.withColumn("d", share("a") - share("b"))
    return o.where("a > 0 or b > 0").select("y", F.round("d", 6).alias("diff"), (F.abs("d") > 15).alias("flagged"))


@query("select coalesce(o_orderstatus, 'all') as status, count(*) filter (o_orderpriority = '1-URGENT') as urgent, count(*) filter (o_orderpriority = '5-LOW') as low, count(*) as total from orders group by rollup (o_orderstatus)")
def crosstab_margins(spark, sf_dir):
    o = table(spark, sf_dir, "orders").rollup("o_orderstatus")
    p = lambda v: F.count_if(F.col("o_orderpriority") == v)
    return o.agg(p("1-URGENT").alias("urgent"), p("5-LOW").alias("low"), F.count("*").alias("total")).select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), "urgent", "low", "total")


# ---- relational operators

@query("""select r_name, year(o_orderdate)::int as y, count(*) as n, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where l_returnflag <> 'R' group by 1, 2""")
def star_join(spark, sf_dir):
    """Fact joined with dimensions; the small ones are broadcast by Spark's own size check."""
    t = lambda n: table(spark, sf_dir, n)
    f = t("lineitem").where("l_returnflag <> 'R'").select("l_orderkey", "l_extendedprice", "l_discount").join(t("orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    f = f.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return f.groupBy("r_name", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("select p.event_id, v.ts as last_view from (select * from events where event_type = 'purchase') p asof left join (select user_id, ts from events where event_type = 'view') v on p.user_id = v.user_id and v.ts <= p.ts")
def asof_join(spark, sf_dir):
    """Each purchase with the user's latest view at or before it: both kinds in one window, no range join."""
    e = table(spark, sf_dir, "events").where("event_type in ('purchase', 'view')")
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "view", 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("event_type") == "view", F.col("ts")), ignorenulls=True).over(w)
    return e.withColumn("last_view", seen).where("event_type = 'purchase'").select("event_id", "last_view")


@query("select b.lo::int as lo, count(*) as n from (select unnest(range(0, 1000, 100)) as lo) b join orders on o_totalprice >= lo * 100 and o_totalprice < (lo + 100) * 100 group by 1")
def range_join(spark, sf_dir):
    """Rows to intervals of a fixed table of ten."""
    b = spark.range(0, 1000, 100).select(F.col("id").cast("int").alias("lo"))
    o = table(spark, sf_dir, "orders").select("o_totalprice")
    return o.join(F.broadcast(b), (F.col("o_totalprice") >= F.col("lo") * 100) & (F.col("o_totalprice") < (F.col("lo") + 100) * 100)).groupBy("lo").agg(F.count("*").alias("n"))


@query("select l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) as gid, count(*) as n, sum(l_quantity) as qty from lineitem group by cube (l_returnflag, l_linestatus)")
def cube_sales(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("gid"), F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


@query("""select o_custkey, o_orderkey, rank() over w as rk, lag(o_orderkey) over w as before, round(avg(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row), 4) as moving from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""")
def rank_window(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.rank().over(w).cast("long").alias("rk"), F.lag("o_orderkey").over(w).alias("before"), F.round(F.avg("o_totalprice").over(w.rowsBetween(-2, 0)), 4).alias("moving"))


@query("select o_orderpriority, count(*) as n from orders o where exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l.l_quantity > 45) and o_totalprice > (select avg(o_totalprice) from orders) group by 1")
def sql_subqueries(spark, sf_dir):
    """The SQL front end: views, a correlated EXISTS and a scalar subquery."""
    o, x = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return spark.sql("with o as (select * from {o}) select o_orderpriority, count(*) as n from o where exists (select 1 from {x} l where l.l_orderkey = o.o_orderkey and l.l_quantity > 45) and o_totalprice > (select avg(o_totalprice) from o) group by 1", o=o, x=x)


@query("select event_type, count(*) as n, count(distinct user_id) as users, round(sum(value), 4) as total, max(json_extract_string(props, '$.k')) as k from events group by event_type")
def json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"), F.max(F.get_json_object("props", "$.k")).alias("k"))


@query()
def approximate_aggregates(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"), F.percentile_approx("value", 0.5).alias("median"))


# ---- events: batch twins of the streaming queries

@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("""with o as (select user_id, ts, (lag(ts) over (partition by user_id order by ts) is null or ts - lag(ts) over (partition by user_id order by ts) >= interval 30 minutes)::int as o from events), s as (select *, sum(o) over (partition by user_id order by ts rows unbounded preceding) as k from o)
select user_id, min(ts) as start, count(*) as n from s group by user_id, k""")
def event_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("select user_id, event_type, min(ts) as first_seen from events group by 1, 2")
def event_dedup(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first_seen"))


@query("select event_id, year(ts)::int as y, strftime(ts, '%Y-%m') as ym, round(date_diff('microsecond', timestamp '2024-01-01', ts) / 86400000000.0::double, 6) as days from events")
def date_parts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.year("ts").alias("y"), F.date_format("ts", "yyyy-MM").alias("ym"), F.round(X.day_gap(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.col("ts")), 6).alias("days"))


# ---- lookups, cutoffs, join strategies, generators

@query("select doc_id, lang, case lang when 'en' then 'English' when 'de' then 'German' when 'fr' then 'French' when 'es' then 'Spanish' end as language from documents")
def map_lookup(spark, sf_dir):
    """A dictionary applied to a column (what it lacks is null): a literal map, no join."""
    names = {"en": "English", "de": "German", "fr": "French", "es": "Spanish"}
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.try_element_at(m, F.col("lang")).alias("language"))


@query("select event_id, strftime(ts, '%Y-%m-%d') as day from events where substr(strftime(ts, '%Y-%m-%dT%H:%M:%S'), 1, 10) >= '2024-01-15'")
def iso_cutoff(spark, sf_dir):
    """Dates as ISO text, kept from a cutoff on by comparing their first ten characters."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, sf_dir, "events").select("event_id", F.substring(iso, 1, 10).alias("day")).where(F.col("day") >= "2024-01-15")


_HINTED = "select o_orderstatus, count(*) as n, round(sum(l_quantity), 4) as qty from orders join lineitem on l_orderkey = o_orderkey group by 1"


def _hinted(spark, sf_dir, hint):
    o, x = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    return x.join(o.hint(hint), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("qty"))


@query(_HINTED)
def sort_merge_join(spark, sf_dir):
    return _hinted(spark, sf_dir, "merge")


@query(_HINTED)
def shuffle_hash_join(spark, sf_dir):
    return _hinted(spark, sf_dir, "shuffle_hash")


@query("select event_id, k::int as k, date_trunc('second', ts) + k * interval 1 hour as at from events, range(0, 3) r(k) where event_type = 'error'")
def generated_rows(spark, sf_dir):
    """A table function in SQL: three rows an hour apart for each error."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", F.date_trunc("second", "ts").alias("ts"))
    return spark.sql("select event_id, k, ts + make_interval(0, 0, 0, 0, k) as at from {e} lateral view explode(sequence(0, 2)) g as k", e=e)
