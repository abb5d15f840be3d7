"""Queries of studies: rank tests with probabilities, the article matrix, faithfulness, picks, bounds, older rules, table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import patterns as P
from corpusloom.functions import scoring as S
from corpusloom.functions import tables
from corpusloom.functions import text as X
from corpusloom.operators import clean, dedup, ranks, segment
from corpusloom.operators import metrics as M
from corpusloom.plans.rule_queries import _FEATURES
from corpusloom.plans.score_queries import _D, BEST, PRED, articles, matrix, predictions, r6
from corpusloom.plans.text_queries import _N, _SQZ, _W, KEY, SENTENCES, docs_of, sents
from corpusloom.registry import query
from corpusloom.session import table


def _erfc(z: str) -> str:
    """SQL of scoring.two_sided for a column."""
    x = f"(abs({z}) / sqrt(2.0::double))"
    t = f"(1.0::double / (1 + {x} / 2))"
    series = f"{S.ERFC[-1]}::double"
    for c in S.ERFC[-2::-1]:
        series = f"({series} * {t} + {c}::double)"
    return f"least(1.0::double, {t} * exp({series} - {x} * {x}))"


_KOLMOGOROV = "case when x < 0.2 then 1.0::double else least(1.0::double, greatest(0.0::double, (select sum(case when k % 2 = 1 then 2.0::double else -2.0::double end * exp(-2.0::double * k * k * x * x)) from generate_series(1, 20) s(k)))) end"


@query(f"""with {PRED}, r as (select y, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0::double as r from d), t as (select sum(t * t * t - t) as ties from (select count(*)::double as t from d group by score)),
m as (select sum(r) filter (y = 1) - n1 * (n1 + 1) / 2 as u, n1, n0 from r, (select (count(*) filter (y = 1))::double as n1, (count(*) filter (y = 0))::double as n0 from d) group by n1, n0), z1 as (select u, (greatest(u, n1 * n0 - u) - n1 * n0 / 2 - 0.5::double) / sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1)))) as z from m, t),
x as (select score - (doc_id % 7) / 2.0::double as d from d), xr as (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2.0::double as r from x where d <> 0), xt as (select sum(t * t * t - t) as ties, sum(t) as n from (select count(*)::double as t from x where d <> 0 group by abs(d))),
w as (select least(sum(r) filter (d > 0), sum(r) filter (d < 0)) as w from xr), z2 as (select w, (w - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24) as z from w, xt)
select 'mann_whitney' as test, round(u, 4) as statistic, round(z, 6) as z, round(case when z < 0 then 1 else {_erfc("z")} end, 6) as p from z1 union all select 'wilcoxon', round(w, 4), round(z, 6), round({_erfc("z")}, 6) from z2""")
def rank_tests(spark, sf_dir):
    """Two-sided rank tests of a score: between classes, and of paired differences."""
    p = predictions(spark, sf_dir)
    u = M.rank_sum(p).select(F.lit("mann_whitney").alias("test"), F.round("u", 4).alias("statistic"), *r6("z", "p"))
    w = M.signed_rank(p.select((F.col("score") - (F.col("doc_id") % 7) / F.lit(2.0)).alias("d")))
    return u.unionByName(w.select(F.lit("wilcoxon").alias("test"), F.round("w", 4).alias("statistic"), *r6("z", "p")))


@query(f"""with e as (select l.quality as y, f.feature, case f.feature when 'quotes' then len(regexp_extract_all(text, '["„”«»]')) when 'commas' then len(regexp_extract_all(text, ',')) else len(regexp_extract_all(text, '[0-9]')) end::double as score from documents join labels l using (doc_id), (values ('quotes'), ('commas'), ('digits')) f(feature)),
c as (select feature, score, count(*) filter (y = 1) as n1, count(*) filter (y = 0) as n0 from e group by all), g as (select feature, n1, n0, abs(sum(n1) over (partition by feature order by score) / sum(n1) over (partition by feature)::double - sum(n0) over (partition by feature order by score) / sum(n0) over (partition by feature)::double) as gap from c),
k as (select feature, ks, ks * sqrt(n1 * n0 / (n1 + n0)) as x from (select feature, max(gap) as ks, sum(n1)::double as n1, sum(n0)::double as n0 from g group by feature)), q as (select feature, covar_pop(score, y::double) / nullif(stddev_pop(score) * stddev_pop(y::double), 0) as r from e group by feature),
a as (select feature, ks, {_KOLMOGOROV} as p, r from k join q using (feature)) select feature, round(ks, 6) as ks, round(p, 6) as p, round(r, 6) as r, (p < 0.01 and abs(coalesce(r, 0)) > 0.15) as candidate from a""")
def structure_candidates(spark, sf_dir):
    """Features that differ between classes (p under 0.01) and go with the label (correlation over 0.15)."""
    d = docs_of(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")
    f = F.array(*[F.struct(F.lit(n).alias("feature"), X.n_matches(F.col("text"), p).cast("double").alias("score")) for n, p in _FEATURES.items()])
    e = d.select("y", F.explode(f).alias("x")).select("y", "x.feature", "x.score")
    r = e.groupBy("feature").agg(M.pearson("score", F.col("y").cast("double")).alias("r"))
    rule = (F.col("p") < 0.01) & (F.abs(F.coalesce("r", F.lit(0.0))) > 0.15)
    return M.ks_test(e, "feature").join(r, "feature").select("feature", *r6("ks", "p", "r"), rule.alias("candidate"))


_AXES = [(t, a, c) for t, c in (("a", "s1"), ("b", "s0"), ("d", "diff")) for a in ("mean", "min", "p10")]


@query(f"""with {BEST}, y as (select (vec_id // 10) % 25 as article, (arg_min(label, vec_id) >= 5)::int as y from embeddings where vec_id % 10 = 0 group by 1), l as (select v.test, v.agg, y.y, case when article % 2 = 0 then 'src1' else 'src2' end as source, case v.test || v.agg {" ".join(f"when '{t}{a}' then {c}_{a}" for t, a, c in _AXES)} end as score from art join y using (article), (values {", ".join(f"('{t}', '{a}')" for t, a, _ in _AXES)}) v(test, agg)),
r as (select *, rank() over (partition by test, agg order by score) + (count(*) over (partition by test, agg, score) - 1) / 2.0::double as r from l)
select test, agg, round((sum(r) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0::double) / nullif(count(*) filter (y = 1) * count(*) filter (y = 0), 0), 6) as auc, {_D}, round(avg(score) filter (y = 1 and source = 'src1') - avg(score) filter (y = 1 and source = 'src2'), 6) as gap, round(avg(score) filter (y = 0), 6) as mean0, round(avg(score) filter (y = 1), 6) as mean1 from r group by test, agg""")
def article_matrix(spark, sf_dir):
    """Scores against class 1, class 0 and their difference, each as mean, minimum and 10th percentile of an article: separation by label."""
    q = table(spark, sf_dir, "embeddings").where("vec_id % 10 = 0").withColumn("article", F.floor(F.col("vec_id") / 10) % 25)
    y = q.groupBy("article").agg((F.min_by("label", "vec_id") >= 5).cast("int").alias("y"))
    s = F.array(*[F.struct(F.lit(t).alias("test"), F.lit(a).alias("agg"), F.col(f"{c}_{a}").alias("score")) for t, a, c in _AXES])
    rows = articles(spark, sf_dir).join(y, "article").select("y", F.when(F.col("article") % 2 == 0, "src1").otherwise("src2").alias("source"), F.explode(s).alias("x")).select("y", "source", "x.*")
    mean = lambda k: F.round(F.avg(F.when(F.col("y") == k, F.col("score"))), 6).alias(f"mean{k}")
    return matrix(rows, "test", "agg").join(rows.groupBy("test", "agg").agg(mean(0), mean(1)), ["test", "agg"])


_STRIP = """regexp_replace(w, '^[.,!?;:"'']+|[.,!?;:"'']+$', '', 'g')"""
_KS = (1, 3, 5, 10)


def _capital_share(ws: str) -> str:
    return f"coalesce(len(list_filter({ws}, lambda w: regexp_matches(w, '^\\p{{Lu}}')))::double / nullif(len({ws}), 0), 0)"


_RANKED = f"list_sort(list_distinct(list_transform(list_filter(list_transform(ws, lambda w: {_STRIP}), lambda w: regexp_matches(w, '^\\p{{Lu}}')), lambda w: {{'n': -len(w), 'w': lower(w)}})))[1:10]"


@query(f"""with a as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_W}') as ws from documents), b as (select *, list_transform({_RANKED}, lambda x: x.w) as top from a),
c as (select *, {", ".join(f"list_filter(ws, lambda w: not list_contains(top[1:{k}], lower({_STRIP}))) as rest{k}" for k in _KS)} from b),
e as (select doc_id, {", ".join(f"case when len(top) >= {k} and len(rest{k}) > 0 then {_capital_share('ws')} - {_capital_share(f'rest{k}')} end as drop_{k}" for k in _KS)} from c)
select doc_id, {", ".join(f"round(drop_{k}, 6) as drop_{k}" for k in _KS)}, round(coalesce(list_avg(list_filter([{", ".join(f"drop_{k}" for k in _KS)}], lambda x: x is not null)), 0), 6) as auc from e""")
def faithfulness(spark, sf_dir):
    """How much the share of capitalised words falls when the longest of them are deleted, by document."""
    share = lambda t: F.coalesce(F.try_divide(F.size(F.filter(X.words(t), lambda w: w.rlike(r"^\p{Lu}"))).cast("double"), F.size(X.words(t))), F.lit(0.0))
    bare = F.filter(F.transform(X.words(F.col("text")), lambda w: F.regexp_replace(w, r"^[.,!?;:\"']+|[.,!?;:\"']+$", "")), lambda w: w.rlike(r"^\p{Lu}"))
    top = F.slice(F.sort_array(F.array_distinct(F.transform(bare, lambda w: F.struct((-F.length(w)).alias("n"), F.lower(w).alias("w"))))), 1, max(_KS))
    d = docs_of(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("top", F.transform(top, lambda x: x["w"]))
    return M.faithfulness(d, F.col("top"), share, _KS).select("doc_id", *r6(*[f"drop_{k}" for k in _KS], "auc"))


@query("select doc_id, lang, n_chars, i::int as i from (select doc_id, lang, n_chars, row_number() over (partition by lang order by n_chars, doc_id) as r, count(*) over (partition by lang) as n from documents) join generate_series(0, 4) s(i) on r = floor(i * (n - 1) / 4.0::double)::bigint + 1")
def linspace_picks(spark, sf_dir):
    """Five rows of each group at even distances in the order of a score."""
    d = ranks.numbered(docs_of(spark, sf_dir).select("doc_id", "lang", "n_chars"), ["lang"], F.floor(F.col("n_chars") / 16), [F.col("n_chars"), F.col("doc_id")])
    at = F.filter(F.sequence(F.lit(0), F.lit(4)), lambda i: F.floor(i * (F.col("total") - 1) / F.lit(4.0)) + 1 == F.col("rank"))
    return d.select("doc_id", "lang", "n_chars", F.explode(at).alias("i"))


@query(f"""with {SENTENCES}, u as (select doc_id, pos, n_words from (select *, row_number() over (partition by {KEY.replace("text", "sentence")} order by doc_id, pos) as rn from sentences) where rn = 1), b as (select floor(quantile_cont(n_words, 0.05))::int as p_low, floor(quantile_cont(n_words, 0.95))::int as p_high from u)
select doc_id, pos::int as pos, n_words, p_low, p_high from u, b where n_words between p_low and p_high""")
def percentile_after_dedup(spark, sf_dir):
    """Sentences within the percentiles of the lengths of distinct sentences."""
    s = sents(spark, sf_dir).select("doc_id", "pos", "n_words", "sentence")
    u = dedup.keep_first(s, X.short_digest(X.dedup_key(F.col("sentence")), "sha256", 32), "doc_id", "pos")
    return segment.between_percentiles(u.drop("sentence")).select("doc_id", "pos", "n_words", "p_low", "p_high")


#: Bounds of words, each with the rule that drops a text for it.
BOUNDS = {"over_2000": (">", 2000), "over_1100": (">", 1100), "under_200": ("<", 200), "under_64": ("<", 64), "under_50": ("<", 50), "under_10": ("<", 10)}


@query(f"""select doc_id, n, array_to_string(list_filter([{", ".join(f"case when n {o} {v} then '{k}' end" for k, (o, v) in BOUNDS.items())}], lambda x: x is not null), '|') as dropped_by from (select doc_id, {_N.format("coalesce(text, '')")} as n from documents)""")
def length_rules(spark, sf_dir):
    """Which bounds would drop each document."""
    n = F.col("n")
    hits = [F.when(n > v if o == ">" else n < v, F.lit(k)) for k, (o, v) in BOUNDS.items()]
    return docs_of(spark, sf_dir).select("doc_id", X.n_words(F.col("text")).alias("n")).withColumn("dropped_by", F.concat_ws("|", *hits))


_PUT = ["Rusia Ucraina și Iran", "Iran Israel, Rusia", "la Kiev", "sirienii din Liban și găgăuzii"]
_TWICE = r"regexp_replace(lower(t), '([^\p{L}\p{N}_])', '\1\1', 'g')"


@query(f"""with t as (select doc_id, coalesce(text, '') || ' ' || case doc_id % 4 {" ".join(f"when {i} then '{x}'" for i, x in enumerate(_PUT))} end as t from documents), n as (select doc_id, len(regexp_extract_all({_TWICE}, '{clean.whole(P.UKRAINE_RUSSIA)}')) as n_ua, len(regexp_extract_all({_TWICE}, '{clean.whole(P.IRAN_ISRAEL)}')) as n_ir from t)
select *, case when n_ir = 0 then 'keep_no_iran' when n_ua >= n_ir then 'keep_ukraine_dominant' else 'drop_iran_dominant' end as verdict from n""")
def subject_dominance(spark, sf_dir):
    """Mentions of two subjects counted against each other (some put in)."""
    k, end = F.col("doc_id") % 4, F.lit(_PUT[3])
    for i in range(3):
        end = F.when(k == i, _PUT[i]).otherwise(end)
    t = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), end)
    d = docs_of(spark, sf_dir).select("doc_id", clean.n_whole(t, P.UKRAINE_RUSSIA).alias("n_ua"), clean.n_whole(t, P.IRAN_ISRAEL).alias("n_ir"))
    return d.withColumn("verdict", clean.dominance(F.col("n_ua"), F.col("n_ir")))


_ENDS = [" Azi, transmite Agerpres . Bine. Sursa: GAZETA / Rador Radio Romania.", ", relatează AFP, preluată de Agerpres. Citește și ceva", ""]


@query(rf"""with t as (select doc_id, coalesce(text, '') || case doc_id % 3 when 0 then '{_ENDS[0]}' when 1 then '{_ENDS[1]}' else '' end as t from documents), a as (select doc_id, trim(regexp_replace(t, '{P.SOURCE_NOTE}', '')) as t from t), b as (select doc_id, {_SQZ.format(f"regexp_replace(t, '{P.INLINE_ATTRIBUTION}', ' ', 'g')")} as t from a)
select doc_id, trim(regexp_replace(t, '{P.LINKS_AT_END}', '')) as cleaned from b""")
def older_cleaner(spark, sf_dir):
    """The older article cleaner on documents with such endings put in."""
    k = F.col("doc_id") % 3
    t = F.concat(F.coalesce("text", F.lit("")), F.when(k == 0, _ENDS[0]).when(k == 1, _ENDS[1]).otherwise(""))
    return docs_of(spark, sf_dir).select("doc_id", clean.older_article(t).alias("cleaned"))


@query("select d.doc_id, (d.n_chars > 1200)::int as pred_a, l.toxic as pred_b, (d.n_chars > 1200)::int <> l.toxic as differ from documents d left join labels l on l.doc_id = d.doc_id where d.doc_id in (select doc_id from labels)")
def two_predictions(spark, sf_dir):
    """Two sets of predictions side by side; the join is checked to be complete for the documents that both have."""
    a = docs_of(spark, sf_dir).select("doc_id", (F.col("n_chars") > 1200).cast("int").alias("pred_a"))
    b = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("pred_b"))
    j = dedup.check_complete(a.join(b.select("doc_id"), "doc_id", "left_semi").join(b, "doc_id", "left"), "pred_b")
    return j.withColumn("differ", F.col("pred_a") != F.col("pred_b"))


@query(f"""with t as (select page_id, lower(case when page_id % 4 = 0 then 'Propaganda: ' when page_id % 4 = 1 then 'Fals: ' else '' end || regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) as t from pages), s as (select 100.0::double * count(*) filter (regexp_matches(t, '{P.CUT_TITLES}') or regexp_matches(t, '{P.EXCLUDED_TITLES}')) / count(*) as p from t)
select round(p, 6) as pct, case when p > 50 then 'exclude_toate' when p > 20 then 'curatare_selectiva' else 'include' end as decision from s""")
def title_decision(spark, sf_dir):
    """Whether titles can be used, by the share that carries a pattern (prefixes put in)."""
    k = F.col("page_id") % 4
    t = F.lower(F.concat(F.when(k == 0, "Propaganda: ").when(k == 1, "Fals: ").otherwise(""), F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)))
    s = table(spark, sf_dir, "pages").agg((100.0 * F.count_if(t.rlike(P.CUT_TITLES) | t.rlike(P.EXCLUDED_TITLES)) / F.count("*")).alias("p"))
    return s.select(F.round("p", 6).alias("pct"), clean.title_decision(F.col("p")).alias("decision"))


@query(rf"""with w as (select item_id, regexp_extract_all(text, '{_W}') as w from benchmark) select item_id, (i - 1)::int as pos, array_to_string(w[i:i + 2], ' ') as piece from (select item_id, w, unnest(generate_series(1, len(w) - 2)) as i from w)""")
def word_windows(spark, sf_dir):
    """A table function joined laterally in SQL: runs of three words of each item."""
    tables.register(spark)
    return spark.sql("select item_id, x.pos, x.piece from {b} b, lateral word_windows(b.text, 3) x", b=table(spark, sf_dir, "benchmark"))


@query("select event_id, try_cast(json_extract_string(props, '$.k') as int) as k from events")
def variant_props(spark, sf_dir):
    """A field of semi-structured values, parsed once as variants."""
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))
