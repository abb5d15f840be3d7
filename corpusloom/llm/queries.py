"""One thin query for each operator of this subpackage, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import chat_format, exact_topk, html_wrapper, mixing, near_dedup, packing, quality_crf, quality_rules, unigram_counts, warc
from corpusloom.session import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.apply(docs, quality_rules.trusted(table(spark, sf_dir, "labels"))).drop("text")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_counts.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_crf.apply(docs, table(spark, sf_dir, "labels")).drop("text")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.assign(table(spark, sf_dir, "documents"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with known damage: a byte changed in some pages (page_id % 97 = 5), some lost (page_id % 211 = 7)."""
    html = F.when(F.col("page_id") % 97 == 5, F.concat(F.lit("#"), F.substr("html", F.lit(2)))).otherwise(F.col("html"))
    return pages.withColumn("html", html).where(F.coalesce(F.col("page_id") % 211 != 7, F.lit(True)))


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.findings(warc.records(pages), warc.records(damaged(pages)))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return chat_format.digests(chat_format.format_conversations(rows.unionByName(extra)))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_best_fit_packing, op3_token_counts, op4_quality_classifier, op5_source_mixing, op6_near_dedup, op7_warc_fixity, op8_exact_topk, op9_chat_format, op10_html_extraction)}

_RECORD = """'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::varchar, '') || '>' || chr(13) || chr(10)
 || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
 || 'Content-Type: application/http;msgtype=response' || chr(13) || chr(10) || 'Content-Length: ' || strlen(body) || chr(13) || chr(10) || chr(13) || chr(10) || body || chr(13) || chr(10) || chr(13) || chr(10)"""
_BODY = "'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '')"


def _replica(html: str, where: str) -> str:
    body = _BODY.replace("coalesce(html", f"coalesce({html}")
    rows = f"select page_id, url, {body} as body from pages where {where}"
    text = f"select page_id, {_RECORD} as r from ({rows})"
    sized = f"select page_id, page_id >> 10 as file, strlen(r) as size, sha256(r) as digest from ({text})"
    bucket = "case when page_id is null then substr(digest, 1, 3) end"
    return f"""select file, row_number() over w - 1 as pos, page_id, (sum(size) over w - size)::bigint as "start", (sum(size) over w)::bigint as "end", digest, row_number() over (partition by page_id, digest) as k from ({sized}) window w as (partition by file, {bucket} order by page_id, digest rows unbounded preceding)"""


SQL = {
    "op7_warc_fixity": f"""with a as ({_replica("html", "true")}), b as ({_replica("case when page_id % 97 = 5 then '#' || substr(html, 2) else html end", "coalesce(page_id % 211 <> 7, true)")}),
e as (select a.file, a.pos, a.page_id, a."start", a."end", a.digest, case when a."start" <> b."start" or a."end" <> b."end" then 'moved' else 'intact' end as status from a join b on a.page_id is not distinct from b.page_id and a.digest = b.digest and a.k = b.k),
u as (select *, row_number() over (partition by page_id order by digest, pos) as r from a where not exists (select 1 from b where a.page_id is not distinct from b.page_id and a.digest = b.digest and a.k = b.k)),
v as (select *, row_number() over (partition by page_id order by digest, pos) as r from b where not exists (select 1 from a where a.page_id is not distinct from b.page_id and a.digest = b.digest and a.k = b.k))
select * from e union all select coalesce(u.file, v.file), coalesce(u.pos, v.pos), coalesce(u.page_id, v.page_id), coalesce(u."start", v."start"), coalesce(u."end", v."end"), coalesce(u.digest, v.digest),
 case when v.digest is null then 'missing' when u.digest is null then 'extra' else 'corrupt' end from u full join v on u.page_id is not distinct from v.page_id and u.r = v.r""",
    "op8_exact_topk": """with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id),
r as (select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s)
select * from r where rank <= 10""",
    "op9_chat_format": """with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
 union all select * from (values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) as x(conv_id, turn, role, text)),
o as (select *, lag(role) over w as before, row_number() over w as k, row_number() over (partition by conv_id order by turn desc nulls last, role desc, text desc) as last,
 len(text) + len(regexp_extract_all(text, '\\\\')) + 2 * len(regexp_extract_all(text, '<<SYS>>|<</SYS>>|\\[INST\\]|\\[/INST\\]|<s>|</s>|\\[ROLE\\]|\\[TEXT\\]|\\[/ROLE\\]')) as escaped
 from t window w as (partition by conv_id order by turn nulls first, role, text)),
c as (select *, case role when 'system' then 15 when 'user' then 13 when 'assistant' then 7 else 19 + len(role) end + escaped as chars,
 case when k = 1 then role in ('system', 'user') when before = 'system' then role = 'user' when before = 'user' then role = 'assistant' when before = 'assistant' then role = 'user' else false end and (last > 1 or role in ('user', 'assistant')) as fits from o)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
 coalesce(sum(len(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
 sum(chars)::bigint as formatted_chars, bool_and(fits) as valid from c group by conv_id""",
}
