"""Cleaning rules as columns: flags, first-match actions, audits. Rules are data (functions.patterns)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpusloom.functions import patterns as P
from corpusloom.functions import text as X


def flags(rows: DataFrame, patterns: dict[str, str], prefix: str = "", col: str = "sentence") -> DataFrame:
    low = F.lower(col)
    return rows.withColumns({prefix + n: (F.col(col) if n in P.CASED else low).rlike(p) for n, p in patterns.items()})


def structure(s: DataFrame) -> DataFrame:
    """Signs of pasted titles: no end mark, opening quote, many quotes, a bare label, many capitals."""
    t = F.col("sentence")
    count = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    return s.withColumns(
        {
            "no_end": ~F.rtrim(t).rlike(r'[.!?…:;")]$'), "opens_quoted": F.ltrim(t).rlike('^[„"«]'), "many_quotes": (count("„") >= 2) | (count('"') >= 4),
            "label_only": F.trim(t).rlike(":$") & (F.col("n_words") <= 3), "many_capitals": X.capital_share(t) > 0.25,
        }
    )


def residual_flags(s: DataFrame) -> DataFrame:
    """The pattern detectors of residual noise plus speaker label, orphaned quotes and too few letters."""
    t = F.col("sentence")
    n = lambda p: X.n_matches(t, p)
    opening, closing = n("[\"“„«‟❝]"), n("[\"”»]")
    label = F.trim(t).rlike(r"^\p{Lu}[\p{L}\p{N}_\-.\s]{0,80}\s*:\s*$") & (X.n_words(F.replace(t, F.lit(":"), F.lit(""))) <= 6)
    return flags(s, P.RESIDUAL).withColumns({"speaker": label, "orphan_quotes": (opening != closing), "few_letters": X.letter_share(t) < 0.5})


def audit(s: DataFrame) -> DataFrame:
    """`category` of each sentence: the last rule that holds wins, so they are tested from the last."""
    f = structure(flags(s, P.BOILERPLATE))
    boiler = F.greatest(*[F.col(n) for n in P.BOILERPLATE])
    short = (F.col("n_words") < 5) & F.col("no_end")
    suspicion = sum((F.col(c).cast("int") for c in ("many_quotes", "label_only", "many_capitals")), short.cast("int"))
    category = F.when(short & ~boiler, "titlu_scurt_probabil").when(F.col("label_only") & (suspicion >= 1), "eticheta_vorbitor").when(suspicion >= 2, "titluri_concatenate").when(boiler, "boilerplate_cms").otherwise("probabil_curat")
    return f.withColumn("suspicion", suspicion).withColumn("category", category)


def noise_decision(pct: Column) -> Column:
    return F.when(pct < 2, "negligible").when(pct <= 5, "moderate").otherwise("clean again")


def title_decision(pct: Column) -> Column:
    """What to do with titles of which pct % carry a pattern."""
    return F.when(pct > 50, "exclude_toate").when(pct > 20, "curatare_selectiva").otherwise("include")


def residual(s: DataFrame) -> DataFrame:
    """`action` (first rule that holds) and `cleaned` of each sentence."""
    t = F.col("sentence")
    rest = F.regexp_replace(t, P.PHOTO_PREFIX, "")
    action = (
        F.when(F.lower(t).rlike(P.READ_ALSO), "aruncat_citeste_si").when(F.trim(t).rlike(":$") & (F.col("n_words") <= 6), "aruncat_eticheta_vorbitor")
        .when(((F.col("n_words") <= 1) & (F.length(F.trim(t)) <= 5)) | ((F.col("n_words") < 4) & (X.letter_share(t, of_all=False) < 0.6)), "aruncat_degenerat")
        .when(t.rlike(P.PHOTO_PREFIX), F.when(X.n_words(rest) < 4, "aruncat_foto_prea_scurt").otherwise("curatat_foto_prefix")).otherwise("nemodificat")
    )
    out = s.withColumn("action", action)
    return out.withColumn("cleaned", F.when(F.col("action").startswith("aruncat"), "").when(F.col("action") == "curatat_foto_prefix", F.trim(rest)).otherwise(t))


_BANNERS = [re.compile(p, re.I | re.S) for p in P.BANNERS]


def _without_banners(text: str, least: int = 6, rounds: int = 5) -> tuple[str, str]:
    first = None
    for _ in range(rounds):
        m = next((m for p in _BANNERS if (m := p.search(text))), None)
        if m is None:
            break
        before, after = (_unquoted(x) for x in (text[: m.start()], text[m.end() :]))
        keeps_before, keeps_after = len(before.split()) >= least, len(after.split()) >= least
        if not keeps_before and not keeps_after:
            return "", "aruncat_banner_pur"
        text, step = (before, "curatat_sufix") if keeps_before else (after, "curatat_prefix")
        first = first or step
    if first and len(text.split()) < least:
        return "", "aruncat_prea_scurt_dupa_curatare"
    return text, first or "nemodificat"


def _unquoted(t: str) -> str:
    """Closing quotes at the end away, as many as have no partner."""
    for pair in ("„”", "«»"):
        surplus = t.count(pair[1]) - t.count(pair[0])
        if surplus > 0:
            t = re.sub(rf"(?:{pair[1]}\s*){{1,{surplus}}}\Z", "", t.strip())
    return t.strip()


@F.pandas_udf(StructType([StructField("cleaned", StringType()), StructField("action", StringType())]))
def _banner_step(t: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_without_banners(x or "") for x in t], columns=["cleaned", "action"])


def banners(s: DataFrame) -> DataFrame:
    """Consent banners cut, the longer side kept; only sentences that mention one go through Python."""
    hit = F.lower("sentence").rlike(X.any_of(P.BANNERS))
    out = s.withColumn("_hit", hit)
    touched = out.where("_hit").withColumn("_b", _banner_step("sentence")).select("*", "_b.*").drop("_b")
    return touched.unionByName(out.where(F.coalesce(~F.col("_hit"), F.lit(True))).withColumns({"cleaned": F.col("sentence"), "action": F.lit("nemodificat")})).drop("_hit")


def article(d: DataFrame) -> DataFrame:
    """`cleaned` and the `actions` that changed the text, in their order. Repeated strips are one anchored pattern each."""
    steps = [("sursa", P.SOURCE_TAIL), ("citeste_si", P.READ_ALSO_TAIL), ("prefix_editorial", P.EDITORIAL), ("rador", P.AGENCY_TAIL), ("attribution", P.ATTRIBUTION_TAIL)]
    out, last, acts = d, "text", []
    for i, (name, pattern) in enumerate(steps):
        cut = F.regexp_replace(last, pattern, "$1" if name == "prefix_editorial" else "")
        out = out.withColumn(f"_t{i}", F.trim(cut) if name == "attribution" else cut)
        acts.append(F.when(F.col(last) != F.col(f"_t{i}"), F.lit(name)))
        last = f"_t{i}"
    out = out.withColumn("actions", F.concat_ws("|", *acts)).withColumn("cleaned", X.trim_tail(F.col(last)))
    return out.drop(*[f"_t{i}" for i in range(len(steps))])


def external(s: DataFrame, suffixes: list[str], drops: list[str], low: int = 7, high: int = 54) -> DataFrame:
    """Suffixes cut, sentences with a drop pattern emptied, then the length rule: `cleaned` and `action`."""
    cut = F.regexp_replace("sentence", "(?i)" + X.any_of(suffixes), "")
    bad = F.lower("sentence").rlike(X.any_of(drops))
    out = s.withColumn("cleaned", F.when(bad, "").otherwise(F.trim(cut)))
    n = X.n_words(F.col("cleaned"))
    return out.withColumn("action", F.when(bad, "dropped").when(~n.between(low, high), "length").when(F.col("cleaned") != F.trim("sentence"), "cut").otherwise("same"))


def topics(d: DataFrame, core: dict[str, str], hybrid: dict[str, str]) -> DataFrame:
    c, h = X.matched(F.col("text"), core), X.matched(F.col("text"), hybrid)
    return d.withColumns({"core": F.size(c) > 0, "hybrid": F.size(h) > 0, "matched": F.concat(c, h)})


def live_text(title: Column, body: Column, published: Column, updated: Column, title_sign: str = P.LIVE_TITLE, body_sign: str = P.LIVE_BODY, update_sign: str = P.LIVE_UPDATE) -> Column:
    """A running report: by its title, a marker in the body, three marked updates, or over 30 days between publication and update."""
    signs = [F.lower(title).rlike(title_sign), F.lower(body).rlike(body_sign), X.n_matches(body, update_sign) >= 3, X.day_gap(published, updated) > 30]
    return F.greatest(*[F.coalesce(x, F.lit(False)) for x in signs])


def leaks(t: Column, patterns: dict[str, str] = P.LEAKS, heading: str = P.LEAKED_HEADING) -> Column:
    """A fact-check's own words in what should be a quotation."""
    return F.coalesce(F.lower(t).rlike(X.any_of(patterns.values())) | t.rlike(heading), F.lit(False))


def extraction_quality(story: Column, summary: Column, story_leaks: Column, summary_leaks: Column, low: int = 20, high: int = 1100) -> Column:
    """Five levels: the story decides if there is one, else the summary."""
    n = X.n_words(story)
    by_story = F.when(story_leaks, "suspect_contaminare").when((n < low) | (n > high), "suspect_dimensiune").otherwise("excelenta")
    by_summary = F.when(summary_leaks, "suspect_contaminare").otherwise("buna")
    has = lambda t: F.coalesce(t, F.lit("")) != ""
    return F.when(has(story), by_story).when(has(summary), by_summary).otherwise("fallback_verificare_manuala")


def in_window(title: Column, body: Column, words: list[str], chars: int = 600) -> Column:
    """A keyword in the title or the first characters of the body."""
    zone = F.lower(F.concat(title, F.lit(" "), F.substring(body, 1, chars)))
    return F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(zone, w))


def accepted(category: Column, allowed: tuple[str, ...] = P.CATEGORIES) -> Column:
    """No category, or one that names an accepted kind."""
    c = F.lower(F.coalesce(category, F.lit("")))
    return (c == "") | F.exists(F.array(*map(F.lit, allowed)), lambda a: F.contains(c, a))


def normal_title(title: Column) -> Column:
    """(title, action): excluded, prefix cut, or as it is."""
    t = F.trim(F.coalesce(title, F.lit("")))
    low = F.lower(t)
    cut = F.trim(F.regexp_replace(t, "(?i)" + P.CUT_TITLES, ""))
    action = F.when((t == "") | low.rlike(P.EXCLUDED_TITLES), "exclude").when(low.rlike(P.CUT_TITLES), F.when(cut == "", "exclude").otherwise("prefix_taiat")).otherwise("ok")
    return F.struct(F.when(action == "exclude", "").otherwise(cut).alias("title"), action.alias("action"))


def article_body(t: Column) -> Column:
    """Editor tail, captions, the running report's notice, and a list of related links in the last quarter away."""
    t = F.regexp_replace(t, P.EDITOR_TAIL, "")
    for line in P.CAPTION_LINES:
        t = F.regexp_replace(t, line, "")
    t = X.cut_tail_from(F.regexp_replace(t, P.LIVE_SENTENCE, ""), P.RELATED, 0.75)
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[ \\t]+", " "), "\\n{3,}", "\n\n"))


def promoted(rows: DataFrame) -> DataFrame:
    """rows (level, title, story, ...): suspects become `excelenta`, fallbacks go; `rebuilt` is the text of those found contaminated."""
    text = F.trim(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("story", F.lit(""))))
    out = rows.where("level <> 'fallback_verificare_manuala'").withColumn("rebuilt", F.when(F.col("level") == "suspect_contaminare", text).otherwise(""))
    return out.withColumn("level", F.when(F.col("level").startswith("suspect"), "excelenta").otherwise(F.col("level")))


def older_article(t: Column) -> Column:
    """The older cleaner: source note at the end, attributions between sentences, links at the end."""
    t = F.trim(F.regexp_replace(t, P.SOURCE_NOTE, ""))
    t = X.squeeze(F.regexp_replace(t, P.INLINE_ATTRIBUTION, " "))
    return F.trim(F.regexp_replace(t, P.LINKS_AT_END, ""))


def n_whole(t: Column, words: str) -> Column:
    """Matches of a pattern that begin and end at a word's boundary, whatever the letters and the case.

    Separators are doubled first, so that neighbouring matches have one each.
    """
    return X.n_matches(F.regexp_replace(F.lower(t), r"([^\p{L}\p{N}_])", "$1$1"), whole(words))


def whole(words: str) -> str:
    return P.B + words.replace(r"\w", P.LETTER) + P.E


def dominance(a: Column, b: Column, names: tuple[str, str, str] = ("keep_no_iran", "keep_ukraine_dominant", "drop_iran_dominant")) -> Column:
    """Which of two topics an article is about, by matches."""
    return F.when(b == 0, names[0]).when(a >= b, names[1]).otherwise(names[2])


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) where an item's text stands in a document.

    Items of seven words or more are looked up by their second to sixth word, which must then be whole words of the
    document: an equi-join on hashed 5-grams, then the exact test. Shorter items (few) are tested directly.
    """
    w = X.words(F.col("text"))
    gram = lambda a, i: F.array_join(F.slice(a, i, 5), " ")
    items = items.where(F.length("text") > 0).select("item_id", F.col("text").alias("item"), w.alias("w"))
    anchors = items.where(F.size("w") >= 7).select("item_id", F.xxhash64(gram(F.col("w"), 2)).alias("g"))
    grams = docs.select("doc_id", w.alias("w")).where(F.size("w") >= 5)
    grams = grams.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 4), lambda i: F.xxhash64(gram(F.col("w"), i))))).alias("g"))
    maybe = grams.join(anchors, "g").select("doc_id", "item_id").distinct()  # texts come only to these few pairs
    long = docs.join(maybe, "doc_id").join(items.select("item_id", "item"), "item_id").where(F.col("text").contains(F.col("item"))).select("doc_id", "item_id")
    short = docs.join(items.where(F.size("w") < 7), F.col("text").contains(F.col("item"))).select("doc_id", "item_id")
    return long.unionByName(short).distinct()


def sections(turns: DataFrame) -> DataFrame:
    """Rows of a role open a section that lasts until the role changes: (conv_id, k, section, body, n)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    opens = (F.col("role") != F.lag("role", 1, "").over(w)).cast("int")
    t = turns.withColumn("_o", opens).withColumn("k", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = t.groupBy("conv_id", "k", F.col("role").alias("section")).agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("p"), F.count("*").alias("n"))
    return g.select("conv_id", "k", "section", F.array_join(F.col("p.text"), " ").alias("body"), "n")


def prefixed_sections(paragraphs: DataFrame, markers: dict[str, str]) -> DataFrame:
    """Paragraphs (id, pos, text): one whose start matches a marker opens that section; the rest joins the open one."""
    marker = F.coalesce(*[F.when(F.upper("text").rlike("^" + p), F.lit(n)) for n, p in markers.items()])
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = paragraphs.withColumn("section", F.last(marker, ignorenulls=True).over(w)).where("section is not null")
    g = t.groupBy("id", "section").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("p"))
    return g.select("id", "section", F.array_join(F.col("p.text"), "\n").alias("body"))
