"""Queries of article rules: windows, leaks, quality, titles, bodies, length and time filters, feature studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import patterns as P
from corpusloom.functions import text as X
from corpusloom.operators import clean, html
from corpusloom.operators import metrics as M
from corpusloom.plans.score_queries import PRED, predictions
from corpusloom.plans.text_queries import _N, _PLAIN, SENTENCES, _drop_sql, docs_of, sents
from corpusloom.registry import query
from corpusloom.session import table


@query("""select doc_id, len(list_filter(['the and', 'und die', 'de la'], lambda w: contains(lower(lang || ' ' || substr(text, 1, 600)), w))) > 0 as hit, (source = '' or contains(source, 'src1')) as accepted from documents""")
def keyword_window(spark, sf_dir):
    d = docs_of(spark, sf_dir)
    return d.select("doc_id", clean.in_window(F.col("lang"), F.col("text"), ["the and", "und die", "de la"]).alias("hit"), clean.accepted(F.col("source"), ("src1",)).alias("accepted"))


_LEAKS = "|".join(f"(?:{p})" for p in [*P.LEAKS.values(), P.TEST_CORE["erhe"]])


@query(f"select doc_id, regexp_matches(lower(text), '{_LEAKS}') or regexp_matches(text, '{P.LEAKED_HEADING}') as leaks from documents")
def leak_predicate(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", clean.leaks(F.col("text"), P.LEAKS | {"erhe": P.TEST_CORE["erhe"]}).alias("leaks"))


@query(f"""with d as (select doc_id, case when doc_id % 5 < 3 then text else '' end as story, case when doc_id % 5 < 4 then text else '' end as summary, regexp_matches(lower(text), '{_LEAKS}') as leak from documents), n as (select *, {_N.format("story")} as n from d)
select doc_id, case when story <> '' then case when leak then 'suspect_contaminare' when n < 20 or n > 1100 then 'suspect_dimensiune' else 'excelenta' end when summary <> '' then case when leak then 'suspect_contaminare' else 'buna' end else 'fallback_verificare_manuala' end as quality from n""")
def extraction_quality(spark, sf_dir):
    part = lambda k: F.when(F.col("doc_id") % 5 < k, F.col("text")).otherwise("")
    leak = F.lower("text").rlike(_LEAKS)
    return docs_of(spark, sf_dir).select("doc_id", clean.extraction_quality(part(3), part(4), leak, leak).alias("quality"))


@query(r"""select doc_id, regexp_matches(lower(text), 'er\s*er') or len(regexp_extract_all(text, 'The')) >= 3 or doc_id % 31 = 30 as live from documents""")
def live_text(spark, sf_dir):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    end = F.timestamp_add("DAY", F.when(F.col("doc_id") % 31 == 30, 31).otherwise(1), start)
    return docs_of(spark, sf_dir).select("doc_id", clean.live_text(F.col("lang"), F.col("text"), start, end, "never", r"er\s*er", "The").alias("live"))


@query(f"with w as (select doc_id, source, {_N.format('text')} as n from documents) select source, count(*) filter (n > 2000) as too_long, count(*) filter (n < 64) as too_short, count(*) filter (n between 64 and 1100) as usual from w group by source")
def length_drops(spark, sf_dir):
    d = docs_of(spark, sf_dir).select("source", X.n_words(F.col("text")).alias("n"))
    return d.groupBy("source").agg(F.count_if(F.col("n") > 2000).alias("too_long"), F.count_if(F.col("n") < 64).alias("too_short"), F.count_if(F.col("n").between(64, 1100)).alias("usual"))


@query("select o_orderkey, year(o_orderdate)::int as y from orders where o_orderdate is not null and not (year(o_orderdate) = 1995 or strftime(o_orderdate, '%Y-%m') = '1996-03')")
def temporal_drops(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderdate is not null")
    return o.where(~((F.year("o_orderdate") == 1995) | (F.date_format("o_orderdate", "yyyy-MM") == "1996-03"))).select("o_orderkey", F.year("o_orderdate").alias("y"))


@query(f"""with h as (select page_id, {_PLAIN.format("regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)")} as h1, {_PLAIN.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} as e from pages),
t as (select page_id, trim(case when page_id % 4 = 0 then 'Propaganda: ' when page_id % 4 = 1 then 'Fals: ' else '' end || coalesce(nullif(h1, ''), e)) as t from h), a as (select *, trim(regexp_replace(t, '(?i){P.CUT_TITLES}', '')) as cut from t),
b as (select *, case when t = '' or regexp_matches(lower(t), '{P.EXCLUDED_TITLES}') then 'exclude' when regexp_matches(lower(t), '{P.CUT_TITLES}') then case when cut = '' then 'exclude' else 'prefix_taiat' end else 'ok' end as action from a)
select page_id, action, case when action = 'exclude' then '' else cut end as title from b""")
def title_actions(spark, sf_dir):
    """Whole titles of pages, some with a prefix put in, cleaned."""
    t = F.concat(F.when(F.col("page_id") % 4 == 0, "Propaganda: ").when(F.col("page_id") % 4 == 1, "Fals: ").otherwise(""), html.title(F.col("html")))
    return table(spark, sf_dir, "pages").select("page_id", clean.normal_title(t).alias("t")).select("page_id", "t.action", "t.title")


_CAPTIONS = "t"
for _line in P.CAPTION_LINES:
    _CAPTIONS = f"regexp_replace({_CAPTIONS}, '{_line}', '', 'g')"


@query(rf"""with t as (select doc_id, regexp_replace(text || chr(10) || 'Sursa foto: x' || chr(10) || 'Citește și: ' || lang || chr(10) || 'Editor : y', '{P.EDITOR_TAIL}', '') as t from documents), c as (select doc_id, regexp_replace({_CAPTIONS}, '{P.LIVE_SENTENCE}', '', 'g') as t from t),
a as (select doc_id, t, regexp_matches(t, '{P.RELATED}') as hit, len(regexp_extract(t, '(?s)^(.*?){P.RELATED}', 1)) as cut from c), b as (select doc_id, case when hit and cut > 0.75::double * len(t) then substr(t, 1, cut) else t end as t from a)
select doc_id, trim(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')) as body from b""")
def article_bodies(spark, sf_dir):
    """Bodies with an editor tail, captions and related links put in, cleaned again."""
    t = F.concat("text", F.lit("\nSursa foto: x\nCitește și: "), "lang", F.lit("\nEditor : y"))
    return docs_of(spark, sf_dir).select("doc_id", clean.article_body(t).alias("body"))


_TAIL = "HotNews.ro utilizează cookie-uri și altele"
_EXT = "|".join(f"(?:{p})" for p in P.COOKIE_TAILS)
_EXD = "|".join(f"(?:{p})" for p in P.EXTERNAL_DROPS)


@query(f"""with {SENTENCES}, t as (select doc_id, pos, case when pos % 4 = 0 then sentence || ' {_TAIL}' when pos % 9 = 1 then 'Acest comentariu a fost moderat ' || sentence else sentence end as s from sentences), c as (select *, regexp_matches(lower(s), '{_EXD}') as bad, trim(regexp_replace(s, '(?i){_EXT}', '', 'g')) as cut from t),
d as (select *, case when bad then '' else cut end as cleaned from c) select doc_id, pos::int as pos, cleaned, case when bad then 'dropped' when {_N.format("cleaned")} not between 7 and 54 then 'length' when cleaned <> trim(s) then 'cut' else 'same' end as action from d""")
def external_cleaning(spark, sf_dir):
    s = F.col("sentence")
    d = sents(spark, sf_dir).withColumn("sentence", F.when(F.col("pos") % 4 == 0, F.concat(s, F.lit(" " + _TAIL))).when(F.col("pos") % 9 == 1, F.concat(F.lit("Acest comentariu a fost moderat "), s)).otherwise(s))
    return clean.external(d, list(P.COOKIE_TAILS), list(P.EXTERNAL_DROPS)).select("doc_id", "pos", "cleaned", "action")


_R = ", ".join(f"count(*) filter (regexp_matches({'sentence' if n in P.CASED else 'lower(sentence)'}, '{p}')) as {n}" for n, p in P.RESIDUAL.items())


@query(rf"""with {SENTENCES} select lang, {_R}, count(*) filter (regexp_matches(trim(sentence), '^\p{{Lu}}[\p{{L}}\p{{N}}_\-.\s]{{0,80}}\s*:\s*$') and len(regexp_extract_all(replace(sentence, ':', ''), '[^\x20\x09-\x0D]+')) <= 6) as speaker,
count(*) filter (len(regexp_extract_all(sentence, '["“„«‟❝]')) <> len(regexp_extract_all(sentence, '["”»]'))) as orphan_quotes, count(*) filter (coalesce(len(regexp_replace(sentence, '[^\p{{L}}]', '', 'g'))::double / len(sentence), 0) < 0.5) as few_letters from sentences group by lang""")
def residual_noise(spark, sf_dir):
    """How many sentences each of the ten detectors flags."""
    f = clean.residual_flags(sents(spark, sf_dir))
    return f.groupBy("lang").agg(*[F.count_if(F.col(n)).alias(n) for n in (*P.RESIDUAL, "speaker", "orphan_quotes", "few_letters")])


@query("select doc_id, case when d is null then null else d end as iso from (select doc_id, case when doc_id % 3 = 0 then '2024-' || lpad((doc_id % 12 + 1)::varchar, 2, '0') || '-' || lpad((doc_id % 28 + 1)::varchar, 2, '0') end as d from documents)")
def month_dates(spark, sf_dir):
    names = F.array(*[F.lit(m.upper()) for m in P.MONTHS])
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("publicat "), (F.col("doc_id") % 28 + 1).cast("string"), F.lit(" "), F.element_at(names, (F.col("doc_id") % 12 + 1).cast("int")), F.lit(" 2024 la ora"))).otherwise("fara data")
    return docs_of(spark, sf_dir).select("doc_id", X.month_date(t).alias("iso"))


@query("select doc_id, regexp_replace(t, '^x_([0-9]+)$', 'x_v1r_\\1') as new_id, case when starts_with(t, 'x_') then 'x' else 'other' end as origin from (select doc_id, case when doc_id % 2 = 0 then 'x_' else 'y_' end || lpad(doc_id::varchar, 5, '0') as t from documents)")
def id_rewrite(spark, sf_dir):
    t = F.concat(F.when(F.col("doc_id") % 2 == 0, "x_").otherwise("y_"), F.lpad(F.col("doc_id").cast("string"), 5, "0"))
    return docs_of(spark, sf_dir).select("doc_id", F.regexp_replace(t, "^x_([0-9]+)$", "x_v1r_$1").alias("new_id"), F.when(t.startswith("x_"), "x").otherwise("other").alias("origin"))


@query("select page_id, (select string_agg(x, ' | ') from (select unnest(list_filter(list_transform(regexp_extract_all(html, '(?s)<li><a[^>]*>(.*?)</a>', 1), lambda x: trim(x)), lambda x: len(x) > 5)) as x)) as menu from pages")
def html_lists(spark, sf_dir):
    """Texts of a repeated element, the longer ones joined."""
    items = F.filter(F.transform(F.regexp_extract_all("html", F.lit("(?s)<li><a[^>]*>(.*?)</a>")), lambda x: F.trim(x)), lambda x: F.length(x) > 5)
    return table(spark, sf_dir, "pages").select("page_id", F.nullif(F.array_join(items, " | "), F.lit("")).alias("menu"))


def _body(c: str) -> str:
    return _PLAIN.format(_drop_sql(f"regexp_extract(html, '(?is)<{c}[^>]*>(.*?)</{c}>', 1)"))


@query(f"""with b as (select page_id, html, {_body("article")} as a, {_body("main")} as m, {_PLAIN.format(_drop_sql("html"))} as w from pages)
select page_id, case when len(a) > 200 then a when len(m) > 200 then m else w end as body, array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?is)<(?:em|i)>(.*?)</(?:em|i)>', 1), lambda x: {_PLAIN.format("x")}), lambda x: len(x) > 50), ' | ') as quoted, nullif(regexp_extract(html, '(?i)name="author"[^>]*content="([^"]*)"', 1), '') as author from b""")
def html_bodies(spark, sf_dir):
    """Text of the first container with enough of it, quotations, and author."""
    p = html.meta(table(spark, sf_dir, "pages"))
    return p.select("page_id", html.body(F.col("html"), ["article", "main"]).alias("body"), html.quoted(F.col("html")).alias("quoted"), "author")


_FEATURES = {"quotes": '["„”«»]', "commas": ",", "digits": "[0-9]"}


@query("with d as (select quality as y, unnest([{'f': 'quotes', 'v': len(regexp_extract_all(text, '[\"„”«»]'))}, {'f': 'commas', 'v': len(regexp_extract_all(text, ','))}, {'f': 'digits', 'v': len(regexp_extract_all(text, '[0-9]'))}]) as x from documents join labels using (doc_id)), e as (select x.f as feature, x.v::double as score, y from d), c as (select feature, score, count(*) filter (y = 1) as n1, count(*) filter (y = 0) as n0 from e group by all), g as (select feature, abs(sum(n1) over (partition by feature order by score) / sum(n1) over (partition by feature)::double - sum(n0) over (partition by feature order by score) / sum(n0) over (partition by feature)::double) as gap from c), k as (select feature, max(gap) as ks from g group by feature), r as (select feature, covar_pop(score, y::double) / nullif(stddev_pop(score) * stddev_pop(y::double), 0) as r from e group by feature) select feature, round(ks, 6) as ks, round(r, 6) as r, abs(coalesce(r, 0)) > 0.15 as candidate from k join r using (feature)")
def structure_study(spark, sf_dir):
    """Which text features differ between classes: Kolmogorov-Smirnov distance and correlation per feature."""
    d = docs_of(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")
    f = F.array(*[F.struct(F.lit(n).alias("feature"), X.n_matches(F.col("text"), p).cast("double").alias("score")) for n, p in _FEATURES.items()])
    e = d.select("y", F.explode(f).alias("x")).select("y", "x.feature", "x.score")
    r = e.groupBy("feature").agg(M.pearson("score", F.col("y").cast("double")).alias("r"))
    return M.ks(e, "feature").join(r, "feature").select("feature", F.round("ks", 6).alias("ks"), F.round("r", 6).alias("r"), (F.abs(F.coalesce("r", F.lit(0.0))) > 0.15).alias("candidate"))


@query(f"with {PRED}, b as (select doc_id, y, score, pred, (n_chars > 900)::int as other from d) select y, count(*) as n, round(avg((pred <> other)::int), 6) as flips, round(quantile_cont(score, 0.025), 6) as low, round(quantile_cont(score, 0.975), 6) as high from b group by y")
def prediction_delta(spark, sf_dir):
    """Two predictions side by side: share of flips, and the central 95 % of the score."""
    p = predictions(spark, sf_dir).withColumn("other", (F.col("n_chars") > 900).cast("int"))
    q = F.percentile("score", F.array(F.lit(0.025), F.lit(0.975)))
    g = p.groupBy("y").agg(F.count("*").alias("n"), F.round(F.avg((F.col("pred") != F.col("other")).cast("int")), 6).alias("flips"), q.alias("q"))
    return g.select("y", "n", "flips", F.round(F.col("q")[0], 6).alias("low"), F.round(F.col("q")[1], 6).alias("high"))


@query(f"with {PRED} select doc_id, round(case when pred = 1 then least(score / 5, 1) else 1 - least(score / 5, 1) end, 6) as certainty from d where pred = 0 or score > 3")
def explain_guard(spark, sf_dir):
    """Rows that may be explained, with the certainty of the predicted class."""
    from corpusloom.functions.scoring import certainty

    p = predictions(spark, sf_dir).where("pred = 0 or score > 3")
    return p.select("doc_id", F.round(certainty(F.col("pred"), F.least(F.col("score") / 5, F.lit(1.0))), 6).alias("certainty"))


@query(f"select doc_id, regexp_matches(lower(text), '{P.FLANK}') as flank, array_to_string(list_filter(['the', 'und', 'que'], lambda s: contains(lower(text), s)), ',') as seeds from documents")
def mentions(spark, sf_dir):
    t = F.col("text")
    seeds = F.array_join(F.from_json(X.seeds_in(t, ["the", "und", "que"]), "array<string>"), ",")
    return docs_of(spark, sf_dir).select("doc_id", F.lower(t).rlike(P.FLANK).alias("flank"), seeds.alias("seeds"))


_COMPILED = "|".join(f"(?:{p})" for p in P.COMPILATIONS)


@query(f"""with t as (select doc_id, case doc_id % 5 when 0 then 'Cronica dezinformării: ' when 1 then 'Falsuri în contextul ' else '' end || lang as title from documents) select doc_id, title from t where not regexp_matches(lower(title), '{_COMPILED}')""")
def compilation_titles(spark, sf_dir):
    """Articles without those whose title names a compilation (titles put together here)."""
    i = F.col("doc_id") % 5
    t = F.concat(F.when(i == 0, "Cronica dezinformării: ").when(i == 1, "Falsuri în contextul ").otherwise(""), F.col("lang"))
    return docs_of(spark, sf_dir).select("doc_id", t.alias("title")).where(~F.lower("title").rlike(_COMPILED))


_LEVEL = "case doc_id % 5 when 0 then 'suspect_dimensiune' when 1 then 'suspect_contaminare' when 2 then 'fallback_verificare_manuala' when 3 then 'excelenta' else 'buna' end"


@query(f"""with q as (select doc_id, {_LEVEL} as level, lang as title, text as story from documents)
select doc_id, case when level like 'suspect%' then 'excelenta' else level end as level, md5(case when level = 'suspect_contaminare' then trim(coalesce(title, '') || ' ' || coalesce(story, '')) else '' end) as rebuilt from q where level <> 'fallback_verificare_manuala'""")
def quality_promotion(spark, sf_dir):
    """Suspects promoted (a contaminated one gets its text back from title and story), unverified fallbacks dropped."""
    i = F.col("doc_id") % 5
    level = F.when(i == 0, "suspect_dimensiune").when(i == 1, "suspect_contaminare").when(i == 2, "fallback_verificare_manuala").when(i == 3, "excelenta").otherwise("buna")
    d = docs_of(spark, sf_dir).select("doc_id", level.alias("level"), F.col("lang").alias("title"), F.col("text").alias("story"))
    return clean.promoted(d).select("doc_id", "level", F.md5("rebuilt").alias("rebuilt"))


@query(f"""with d as (select doc_id, regexp_replace(case doc_id % 3 when 0 then 'FAKE NEWS: ' when 1 then 'Propaganda - ' else '' end || text, '{P.LABEL_PREFIX}', '') as cleaned, doc_id % 4 = 0 as about from documents),
t as (select doc_id, cleaned || case when about then ' Kremlin' else '' end as t from d) select doc_id, md5(t) as cleaned, regexp_matches(t, '{P.LABEL_PREFIX}') as still_prefixed from t where regexp_matches(lower(t), '{"|".join(f"(?:{x})" for x in [*P.CORE_TOPICS.values(), *P.HYBRID_TOPICS.values()])}')""")
def offtopic_drop(spark, sf_dir):
    """Label prefixes cut and looked for again, then articles on none of the topics dropped."""
    i = F.col("doc_id")
    t = F.concat(F.when(i % 3 == 0, "FAKE NEWS: ").when(i % 3 == 1, "Propaganda - ").otherwise(""), F.col("text"))
    t = F.concat(F.regexp_replace(t, P.LABEL_PREFIX, ""), F.when(i % 4 == 0, " Kremlin").otherwise(""))
    d = docs_of(spark, sf_dir).select("doc_id", t.alias("t"))
    return d.where(F.lower("t").rlike(X.any_of([*P.CORE_TOPICS.values(), *P.HYBRID_TOPICS.values()]))).select("doc_id", F.md5("t").alias("cleaned"), F.col("t").rlike(P.LABEL_PREFIX).alias("still_prefixed"))
