"""Queries over documents and pages: counts, segments, deduplication, cleaning, topics, HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P
from corpusloom.functions import text as X
from corpusloom.operators import clean, dedup, html, metrics, segment
from corpusloom.registry import query
from corpusloom.session import table

_W = r"[^\x20\x09-\x0D]+"
_N = f"len(regexp_extract_all({{}}, '{_W}'))"
#: SQL of the segmenter: sentences(doc_id, source, lang, pos, sentence, n_words, n_chars).
SENTENCES = rf"""pieces as (select doc_id, source, lang, string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|' || chr(10) || '+') as p from documents where text is not null),
sentences as (select doc_id, source, lang, pos, sentence, {_N.format("sentence")} as n_words, len(sentence) as n_chars from
 (select doc_id, source, lang, unnest(p) as sentence, generate_subscripts(p, 1) - 1 as pos from pieces) where trim(sentence) <> '')"""
_KEY = r"trim(regexp_replace(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
KEY = _KEY.format("text")


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def sents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.sentences(docs_of(spark, sf_dir), "source", "lang")


@query(f"""select doc_id, {_N.format("text")} as n_words, len(text) as n_chars, 1 + len(regexp_extract_all(text, '[.!?][\\x20\\x09-\\x0D]+[A-ZĂÂÎȘȚŞŢÀ-ÖØ-Þ]')) as n_sentences from documents""")
def doc_word_stats(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", X.n_words(F.col("text")).alias("n_words"), X.n_chars(F.col("text")).alias("n_chars"), X.n_sentences(F.col("text")).alias("n_sentences"))


@query(f"""select lang, count(*) as n, min(w) as min, round(quantile_cont(w, 0.25), 6) as p25, round(quantile_cont(w, 0.5), 6) as median, round(quantile_cont(w, 0.75), 6) as p75, max(w) as max, round(avg(w), 6) as mean, round(stddev_samp(w), 6) as std
from (select lang, {_N.format("text")} as w from documents) group by lang""")
def describe_lengths(spark, sf_dir):
    d = metrics.describe(docs_of(spark, sf_dir).select("lang", X.n_words(F.col("text")).alias("w")), "w", "lang")
    return d.select("lang", "n", "min", *[F.round(c, 6).alias(c) for c in ("p25", "median", "p75")], "max", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"with {SENTENCES} select doc_id, pos::int as pos, sentence, n_words, n_chars from sentences")
def sentences(spark, sf_dir):
    return sents(spark, sf_dir).drop("source", "lang")


@query(f"with {SENTENCES} select doc_id, pos::int as pos, n_words from sentences where n_words between 7 and 54")
def sentence_length_filter(spark, sf_dir):
    return segment.between_words(sents(spark, sf_dir)).select("doc_id", "pos", "n_words")


@query(f"with {SENTENCES}, b as (select floor(quantile_cont(n_words, 0.05))::int as p_low, floor(quantile_cont(n_words, 0.95))::int as p_high from sentences) select doc_id, pos::int as pos, n_words, p_low, p_high from sentences, b where n_words between p_low and p_high")
def sentence_percentile_filter(spark, sf_dir):
    return segment.between_percentiles(sents(spark, sf_dir)).select("doc_id", "pos", "n_words", "p_low", "p_high")


@query(f"select doc_id, source, key from (select doc_id, source, {KEY} as key, row_number() over (partition by {KEY} order by doc_id) as rn from documents) where rn = 1")
def dedup_exact_normalized(spark, sf_dir):
    d = docs_of(spark, sf_dir).select("doc_id", "source", X.dedup_key(F.col("text")).alias("key"))
    return dedup.keep_first(d, F.col("key"), "doc_id")


@query("select doc_id, source, n_chars from (select *, row_number() over (partition by sha1(text) order by doc_id desc) as rn from documents) where rn = 1")
def dedup_keep_last(spark, sf_dir):
    return dedup.keep_first(docs_of(spark, sf_dir), F.sha1("text"), F.desc("doc_id")).select("doc_id", "source", "n_chars")


@query(f"select substr(sha1({KEY}), 1, 16) as key, count(*) as n, count(distinct source) as n_sources, min(substr(text, 1, 80)) as sample from documents group by 1 having count(*) > 1")
def dedup_top_repeats(spark, sf_dir):
    d = docs_of(spark, sf_dir).select("source", X.short_digest(X.dedup_key(F.col("text"))).alias("k"), F.substring("text", 1, 80).alias("t"))
    return dedup.repeats(d, F.col("k"), "t")


@query(f"""with d as (select source, row_number() over (partition by {KEY} order by doc_id) as rn from documents)
select source, count(*) as n_before, count(*) filter (rn = 1) as n_after, round(100.0::double * count(*) filter (rn = 1) / count(*), 6) as pct from d group by source""")
def dedup_retention_by_source(spark, sf_dir):
    d = docs_of(spark, sf_dir).select("doc_id", "source", X.dedup_key(F.col("text")).alias("k"))
    d = d.withColumn("first", F.row_number().over(Window.partitionBy("k").orderBy("doc_id")) == 1)
    return d.groupBy("source").agg(F.count("*").alias("n_before"), F.count_if("first").alias("n_after")).withColumn("pct", F.round(100.0 * F.col("n_after") / F.col("n_before"), 6))


@query("select doc_id, item_id from documents d join benchmark b on contains(d.text, b.text) where length(b.text) > 0")
def contamination_check(spark, sf_dir):
    return clean.contained(docs_of(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query(f"select count(*) as n_shared from (select {KEY} as k from documents intersect select {KEY} as k from benchmark)")
def contamination_keys(spark, sf_dir):
    key = lambda n: table(spark, sf_dir, n).select(X.dedup_key(F.col("text")).alias("k"))
    return key("documents").intersect(key("benchmark")).agg(F.count("*").alias("n_shared"))


@query(f"""select doc_id, case when n <= 250 then text else array_to_string(w[1:250], ' ') end as cut, case when n <= 64 then text else array_to_string(w[1:64], ' ') || case when regexp_matches(array_to_string(w[1:64], ' '), '[.!?]$') then '' else '.' end end as ended
from (select doc_id, text, regexp_extract_all(text, '{_W}') as w, {_N.format("text")} as n from documents)""")
def truncate_words(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", X.truncate_words(F.col("text"), 250).alias("cut"), X.truncate_sentence(F.col("text"), 64).alias("ended"))


@query("select d.doc_id, b.text || case when regexp_matches(b.text, '[.!?]$') then ' ' else '. ' end || d.lang as joined, b.text || chr(10) || chr(10) || d.lang as model_input from documents d join benchmark b on b.item_id = d.doc_id")
def text_assembly(spark, sf_dir):
    d = docs_of(spark, sf_dir).select("doc_id", "lang").join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), "doc_id")
    return d.select("doc_id", X.assemble(F.col("text"), F.col("lang")).alias("joined"), F.concat("text", F.lit("\n\n"), "lang").alias("model_input"))


@query("select doc_id, sha1(text) as sha1, md5(text) as md5, substr(sha256(text), 1, 16) as sha256_16 from documents")
def digests(spark, sf_dir):
    t = F.col("text")
    return docs_of(spark, sf_dir).select("doc_id", F.sha1(t).alias("sha1"), F.md5(t).alias("md5"), X.short_digest(t, "sha256").alias("sha256_16"))


@query("with h as (select sha256(doc_id || '|' || text) as h from documents), r as (select substr(h, 1, 3) as p, sha256(string_agg(h, chr(10) order by h)) as d from h group by 1) select sha256(string_agg(d, chr(10) order by p)) as digest from r")
def corpus_digest(spark, sf_dir):
    """Digest of a whole corpus, whatever the order of its rows: row digests are digested by range (4,096 of them), then the ranges."""
    h = docs_of(spark, sf_dir).select(F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "text"), 256).alias("h"))
    joined = lambda c: F.sha2(F.array_join(c, "\n"), 256)
    r = h.groupBy(F.substring("h", 1, 3).alias("p")).agg(joined(F.sort_array(F.collect_list("h"))).alias("d"))
    return r.agg(joined(F.transform(F.sort_array(F.collect_list(F.struct("p", "d"))), lambda x: x["d"])).alias("digest"))


def _flag(col: str, ps: dict[str, str]) -> str:
    q = lambda p: p.replace("'", "''")
    return ", ".join(f"regexp_matches({col if n.removeprefix('r_') in P.CASED else f'lower({col})'}, '{q(p)}') as {n}" for n, p in ps.items())


_NOISE = dict(P.BOILERPLATE)
_RES = {f"r_{k}": v for k, v in P.RESIDUAL.items()}
_STRUCT = rf"""not regexp_matches(rtrim(sentence), '[.!?…:;")]$') as no_end, regexp_matches(ltrim(sentence), '^[„"«]') as opens_quoted,
 (len(sentence) - len(replace(sentence, '„', '')) >= 2 or len(sentence) - len(replace(sentence, '"', '')) >= 4) as many_quotes, (regexp_matches(trim(sentence), ':$') and n_words <= 3) as label_only,
 case when n_words >= 10 then len(list_filter(regexp_extract_all(sentence, '{_W}')[2:], lambda x: regexp_matches(x, '^\p{{Lu}}') and x <> upper(x)))::double / (n_words - 1) else 0 end > 0.25 as many_capitals"""


@query(f"with {SENTENCES} select doc_id, pos::int as pos, {_flag('sentence', _NOISE)}, {_flag('sentence', _RES)}, {_STRUCT} from sentences")
def noise_flags(spark, sf_dir):
    s = sents(spark, sf_dir)
    return clean.structure(clean.flags(clean.flags(s, P.BOILERPLATE), P.RESIDUAL, "r_")).drop("source", "lang", "sentence", "n_words", "n_chars")


_AUDIT = f"""flagged as (select *, {_flag('sentence', _NOISE)}, {_STRUCT} from sentences),
scored as (select *, ({' or '.join(_NOISE)}) as boilerplate, (n_words < 5 and no_end) as short_title, many_quotes::int + label_only::int + many_capitals::int + (n_words < 5 and no_end)::int as suspicion from flagged),
audited as (select *, case when short_title and not boilerplate then 'titlu_scurt_probabil' when label_only and suspicion >= 1 then 'eticheta_vorbitor' when suspicion >= 2 then 'titluri_concatenate' when boilerplate then 'boilerplate_cms' else 'probabil_curat' end as category from scored)"""


@query(f"with {SENTENCES}, {_AUDIT} select source, category, count(*) as n from audited group by all")
def noise_by_source(spark, sf_dir):
    return clean.audit(sents(spark, sf_dir)).groupBy("source", "category").agg(F.count("*").alias("n"))


@query(f"with {SENTENCES}, {_AUDIT}, s as (select 100.0::double * count(*) filter (category <> 'probabil_curat') / count(*) as p from audited) select round(p, 6) as pct, case when p < 2 then 'negligible' when p <= 5 then 'moderate' else 'clean again' end as decision from s")
def noise_decision(spark, sf_dir):
    s = clean.audit(sents(spark, sf_dir)).agg((100.0 * F.count_if(F.col("category") != "probabil_curat") / F.count("*")).alias("p"))
    return s.select(F.round("p", 6).alias("pct"), clean.noise_decision(F.col("p")).alias("decision"))


_SHARE = "coalesce(len(regexp_replace(sentence, '[^\\p{L}]', '', 'g'))::double / nullif(len(regexp_replace(sentence, '\\s', '', 'g')), 0), 0)"


@query(f"""with {SENTENCES}, a as (select *, case when regexp_matches(lower(sentence), '{P.READ_ALSO}') then 'aruncat_citeste_si' when regexp_matches(trim(sentence), ':$') and n_words <= 6 then 'aruncat_eticheta_vorbitor'
 when (n_words <= 1 and len(trim(sentence)) <= 5) or (n_words < 4 and {_SHARE} < 0.6) then 'aruncat_degenerat' when regexp_matches(sentence, '{P.PHOTO_PREFIX}') then case when len(regexp_extract_all(regexp_replace(sentence, '{P.PHOTO_PREFIX}', ''), '{_W}')) < 4 then 'aruncat_foto_prea_scurt' else 'curatat_foto_prefix' end else 'nemodificat' end as action from sentences)
select doc_id, pos::int as pos, action, case when action like 'aruncat%' then '' when action = 'curatat_foto_prefix' then trim(regexp_replace(sentence, '{P.PHOTO_PREFIX}', '')) else sentence end as cleaned from a""")
def residual_actions(spark, sf_dir):
    return clean.residual(sents(spark, sf_dir)).select("doc_id", "pos", "action", "cleaned")


@query()
def banner_actions(spark, sf_dir):
    """Banner removal over sentences, of which every fifth gets a consent banner so that all scenarios occur."""
    banner = "Setarile tale privind cookie-urile nu permit afisarea continutul din aceasta sectiune."
    s = sents(spark, sf_dir).withColumn("sentence", F.when(F.col("pos") % 5 == 0, F.concat(F.lit(banner + " "), "sentence")).when(F.col("pos") % 5 == 1, F.concat("sentence", F.lit(" " + banner))).otherwise(F.col("sentence")))
    return clean.banners(s).select("doc_id", "pos", "action", "cleaned")


@query(rf"""with a as (select doc_id, lang || ' ' || text || ' Sursa: x' as t0 from documents), b as (select doc_id, t0, regexp_replace(t0, '{P.SOURCE_TAIL}', '') as t1 from a), c as (select *, regexp_replace(t1, '{P.READ_ALSO_TAIL}', '') as t2 from b),
d as (select *, regexp_replace(t2, '{P.EDITORIAL}', '\1') as t3 from c), e as (select *, regexp_replace(t3, '{P.AGENCY_TAIL}', '') as t4 from d), f as (select *, trim(regexp_replace(t4, '{P.ATTRIBUTION_TAIL}', '')) as t5 from e),
g as (select *, trim(regexp_replace(trim(regexp_replace(t5, '[\x20\x09-\x0D]+', ' ', 'g')), '[\s,;:/.\-]+$', '')) as t6 from f)
select doc_id, case when t6 = '' or regexp_matches(t6, '[.!?]$') then t6 else t6 || '.' end as cleaned, array_to_string(list_filter([case when t0 <> t1 then 'sursa' end, case when t1 <> t2 then 'citeste_si' end, case when t2 <> t3 then 'prefix_editorial' end, case when t3 <> t4 then 'rador' end, case when t4 <> t5 then 'attribution' end], lambda x: x is not null), '|') as actions from g""")
def cleaner_actions(spark, sf_dir):
    d = docs_of(spark, sf_dir).select("doc_id", F.concat_ws(" ", "lang", "text", F.lit("Sursa: x")).alias("text"))
    return clean.article(d).select("doc_id", "cleaned", "actions")


def _names(col: str, ps: dict[str, str]) -> str:
    return "list_filter([" + ", ".join(f"case when regexp_matches(lower({col}), '{p}') then '{n}' end" for n, p in ps.items()) + "], lambda x: x is not null)"


@query(f"select doc_id, len({_names('text', P.TEST_CORE)}) > 0 as core, len({_names('text', P.TEST_HYBRID)}) > 0 as hybrid, array_to_string({_names('text', P.TEST_CORE | P.TEST_HYBRID)}, '|') as matched, len({_names('text', P.CORE_TOPICS | P.HYBRID_TOPICS)}) as n_named from documents")
def topic_details(spark, sf_dir):
    d = clean.topics(docs_of(spark, sf_dir), P.TEST_CORE, P.TEST_HYBRID)
    return d.select("doc_id", "core", "hybrid", F.array_join("matched", "|").alias("matched"), F.size(X.matched(F.col("text"), P.CORE_TOPICS | P.HYBRID_TOPICS)).cast("long").alias("n_named"))


@query(r"""select doc_id, a, b, case when b = 0 then 'keep' when a >= b then 'keep_a_dominant' else 'drop_b_dominant' end as verdict from (select doc_id, len(regexp_extract_all(lower(text), 'the')) as a, len(regexp_extract_all(lower(text), 'ung')) as b from documents)""")
def topic_dominance(spark, sf_dir):
    low = F.lower("text")
    d = docs_of(spark, sf_dir).select("doc_id", X.n_matches(low, "the").alias("a"), X.n_matches(low, "ung").alias("b"))
    return d.withColumn("verdict", clean.dominance(F.col("a"), F.col("b"), ("keep", "keep_a_dominant", "drop_b_dominant")))


_STRIP = "regexp_replace({}, '<[^>]+>', ' ', 'g')"
_SQZ = r"trim(regexp_replace({}, '[\x20\x09-\x0D]+', ' ', 'g'))"
_ENT = "replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&nbsp;', ' '), '&amp;', '&')"
_PLAIN = _SQZ.format(_ENT.format(_STRIP.format("{}")))


def _drop_sql(col: str) -> str:
    for t in ("script", "style", "nav", "aside", "figure", "form", "iframe", "footer"):
        col = f"regexp_replace({col}, '(?is)<{t}[^>]*>.*?</{t}>', ' ', 'g')"
    return col


@query(f"select page_id, {_PLAIN.format(chr(114) + chr(101) + 'gexp_extract(html, ' + chr(39) + '(?s)<h1[^>]*>(.*?)</h1>' + chr(39) + ', 1)')} as title from pages")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@query(f"select page_id, (unnest(generate_series(1, len(p))) - 1)::int as pos, unnest(p) as paragraph from (select page_id, list_filter(list_transform(regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1), lambda x: {_PLAIN.format('x')}), lambda x: len(x) > 60) as p from pages)")
def html_paragraphs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(html.paragraphs(F.col("html"), 60)).alias("pos", "paragraph"))


@query(f"select page_id, {_PLAIN.format(_drop_sql('html'))} as body from pages")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.visible_text(F.col("html")).alias("body"))


@query(r"""select page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host, regexp_extract(url, '/([0-9]+)', 1) as num, regexp_extract(url, '^[a-z]+://[^/]*/([^/?#]*)', 1) as section, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '') as canonical, regexp_matches(url, '/[0-9]+') as is_article from pages""")
def url_parts(spark, sf_dir):
    return html.url_parts(table(spark, sf_dir, "pages")).select("page_id", "host", "num", "section", "canonical", "is_article")


@query("""select page_id, min(pos) as pos, href from (select page_id, (unnest(generate_series(1, len(h))) - 1)::int as pos, unnest(h) as href from (select page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) as h from pages)) group by page_id, href""")
def html_links(spark, sf_dir):
    return html.links(table(spark, sf_dir, "pages"))


@query(r"""select page_id, nullif(regexp_extract(html, '(20[0-9]{2})-[0-9]{2}-[0-9]{2}', 0), '') as iso, nullif(regexp_extract(html, '(?i)<html[^>]*lang="([^"]+)"', 1), '') as lang, coalesce(case when try_cast(nullif(regexp_extract(html, '(20[0-9]{2})-[0-9]{2}-[0-9]{2}', 1), '') as int) between 2022 and 2026 then try_cast(regexp_extract(html, '(20[0-9]{2})-[0-9]{2}-[0-9]{2}', 1) as int) end, -1) as year from pages""")
def html_meta(spark, sf_dir):
    return html.meta(table(spark, sf_dir, "pages")).select("page_id", "iso", "lang", "year")


@query(f"""with a as (select page_id, {_PLAIN.format("regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)")} as title, {_N.format(_PLAIN.format(_drop_sql("html")))} as n from pages)
select page_id, case when len(title) < 10 then 'short title' when n < 64 then 'too short' when n > 2000 then 'too long' else 'ok' end as reason from a""")
def article_validity(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("title"), X.n_words(html.visible_text(F.col("html"))).alias("n"))
    return p.select("page_id", html.validity(F.col("title"), F.col("n")).alias("reason"))


@query("""select conv_id, k, role as section, string_agg(text, ' ' order by turn) as body, count(*) as n from (select *, sum(o) over (partition by conv_id order by turn rows unbounded preceding)::bigint as k from (select *, (role <> lag(role, 1, '') over (partition by conv_id order by turn))::int as o from conversations)) group by conv_id, k, role""")
def section_state(spark, sf_dir):
    return clean.sections(table(spark, sf_dir, "conversations"))


@query(rf"""with w as (select doc_id, unnest(regexp_extract_all(lower(text), '{_W}')) as word from documents) select word, count(*) as n, count(distinct doc_id) as n_docs from w group by word""")
def token_frequency(spark, sf_dir):
    w = docs_of(spark, sf_dir).select("doc_id", F.explode(X.words(F.lower("text"))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query(rf"""with w as (select doc_id, unnest(regexp_extract_all(lower(text), '{_W}')) as word from documents), c as (select doc_id, word, count(*) as n from w group by all),
t as (select doc_id, list(word) as top from (select *, row_number() over (partition by doc_id order by n desc, word) as rk from c) where rk <= 5 group by doc_id)
select a.doc_id, round(len(list_intersect(a.top, b.top))::double / len(list_distinct(list_concat(a.top, b.top))), 6) as jaccard from t a join t b on b.doc_id = a.doc_id + 1""")
def jaccard_top_words(spark, sf_dir):
    """Jaccard similarity of a document's five most frequent words with the next document's."""
    c = docs_of(spark, sf_dir).select("doc_id", F.explode(X.words(F.lower("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    top = c.withColumn("rk", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "word"))).where("rk <= 5").groupBy("doc_id").agg(F.collect_list("word").alias("top"))
    pair = top.join(top.select((F.col("doc_id") - 1).alias("doc_id"), F.col("top").alias("other")), "doc_id")
    return pair.select("doc_id", F.round(F.size(F.array_intersect("top", "other")) / F.size(F.array_union("top", "other")).cast("double"), 6).alias("jaccard"))


@query(r"select doc_id, len(regexp_replace(text, '[^\x00-\x7F]+', ' ', 'g')) as n_ascii, len(regexp_extract_all(text, '[\p{Cyrillic}]')) as n_cyrillic, len(regexp_extract_all(regexp_replace(text, '[0-9]{3,}', '[ENT]', 'g'), '\[ENT\]')) as n_masked from documents")
def text_ablation(spark, sf_dir):
    t = F.col("text")
    return docs_of(spark, sf_dir).select("doc_id", X.n_chars(X.ablate(t, r"[^\x00-\x7F]+")).alias("n_ascii"), X.n_matches(t, r"[\p{IsCyrillic}]").alias("n_cyrillic"), X.n_matches(X.ablate(t, "[0-9]{3,}", "[ENT]"), r"\[ENT\]").alias("n_masked"))


@query(rf"""select doc_id, {_N.format("text")} as n_words, len(regexp_extract_all(text, '["„”«»]')) as n_quotes, round(coalesce(len(regexp_replace(text, '[\x00-\x7F]', '', 'g'))::double / nullif(len(text), 0), 0), 6) as non_ascii, len(regexp_extract_all(text, chr(10) || '+')) + 1 as n_paragraphs, round(coalesce(len(regexp_replace(text, '[^\p{{L}}]', '', 'g'))::double / nullif(len(text), 0), 0), 6) as letters from (select doc_id, coalesce(text, '') as text from documents)""")
def structural_features(spark, sf_dir):
    """Counts and shares of every document; null and empty texts have none."""
    t = F.coalesce("text", F.lit(""))
    d = docs_of(spark, sf_dir)
    return d.select("doc_id", X.n_words(t).alias("n_words"), X.n_matches(t, '["„”«»]').alias("n_quotes"), F.round(F.coalesce(F.try_divide(F.length(F.regexp_replace(t, r"[\x00-\x7F]", "")).cast("double"), F.length(t)), F.lit(0.0)), 6).alias("non_ascii"), (X.n_matches(t, "\n+") + 1).alias("n_paragraphs"), F.round(X.letter_share(t), 6).alias("letters"))
