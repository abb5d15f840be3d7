"""Hand-written cases of page rules, rank tests and studies."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P
from corpusloom.functions import scoring as S
from corpusloom.functions import text as X
from corpusloom.operators import clean, dedup, html
from corpusloom.operators import metrics as M

# Sentences and the group of topics that each is on.
TOPICS = [
    ("Zelenski a declarat că Ucraina va primi noi rachete", "core"), ("Rusia a bombardat infrastructura energetică a Kievului", "core"), ("Forțele ruse au atacat Bahmut", "core"),
    ("Putin a anunțat mobilizarea parțială", "core"), ("Narațiunea Kremlinului despre denazificarea Ucrainei", "core"), ("Maia Sandu a semnat acordul cu UE", "hybrid"),
    ("Situația din Transnistria rămâne tensionată", "hybrid"), ("Chișinău respinge acuzațiile de la Comrat", "hybrid"), ("Republica Moldova candidează pentru aderarea la UE", "hybrid"),
    ("Rusofobia este un pretext pentru propagandă", "hybrid"), ("Moldova se pregătește pentru alegerile parlamentare", "hybrid"), ("Agricultorii moldoveni cer sprijin de la guvern", "hybrid"),
    ("Moldovenii au votat masiv în diaspora", "hybrid"), ("Guvernul României a aprobat un nou program social", "neither"), ("Vremea va fi însorită în toată țara", "neither"),
    ("Echipa națională a câștigat meciul amical", "neither"), ("Prețul benzinei a scăzut cu 5 bani", "neither"), ("Principatele dunărene în secolul XIX", "neither"),
]


def test_topics_of_known_sentences(spark):
    d = clean.topics(spark.createDataFrame(TOPICS, "text string, group string"), P.CORE_TOPICS, P.HYBRID_TOPICS).collect()
    for r in d:
        assert (r["core"] or r["hybrid"]) == (r["group"] != "neither"), r["text"]
        assert r["group"] == "neither" or r[r["group"]], r["text"]


@pytest.mark.parametrize(
    "sentence,flag,hit",
    [("De Ion Pop | Politica", "header", True), ("de ion pop | politica", "header", False), ("x (n.red. fals) y", "editor_note", True), ("x (N.RED. fals) y", "editor_note", False), ("VEZI ȘI altele", "meta", True)],
)
def test_detectors_that_tell_capitals(spark, sentence, flag, hit):
    s = spark.createDataFrame([(sentence,)], "sentence string").withColumn("n_words", X.n_words(F.col("sentence")))
    assert clean.residual_flags(s).first()[flag] == hit


@pytest.mark.parametrize("text,want", [("FOTO-REPORTAJ din Kiev", "-REPORTAJ din Kiev."), ("FOTO VIDEO: Un text", "Un text."), ("FOTOGRAFII noi", "FOTOGRAFII noi."), ("FOTO VIDEOCLIP nou", "VIDEOCLIP nou."), ("ANALIZĂ", "")])
def test_editorial_prefix_ends_at_a_word(spark, text, want):
    assert clean.article(spark.createDataFrame([(text,)], "text string")).first()["cleaned"] == want


def test_older_cleaner(spark):
    cut = lambda t: spark.createDataFrame([(t,)], "t string").select(clean.older_article(F.col("t"))).first()[0]
    assert cut("Un text. Sursa: KYIV POST / Rador Radio Romania / Traducerea: Sergiu Dan.") == "Un text."
    assert cut("Un text, relatează AFP, preluată de Agerpres. Altul") == "Un text Altul"
    assert cut("Un text. Citește și alte știri") == "Un text."
    assert cut("") == "" and cut(None) is None


def test_subjects(spark):
    d = spark.createDataFrame([("Rusia Ucraina găgăuză", "Iran"), ("șorț", "Iranul"), ("", "Liban, sirienii Gaza")], "a string, b string")
    d = d.select(F.concat_ws(" ", "a", "b").alias("t")).select(clean.n_whole(F.col("t"), P.UKRAINE_RUSSIA).alias("a"), clean.n_whole(F.col("t"), P.IRAN_ISRAEL).alias("b"))
    assert [tuple(r) for r in d.collect()] == [(3, 1), (0, 0), (0, 2)]


def plain_ranks(xs):
    s = sorted(xs)
    return [(s.index(x) + 1 + s.index(x) + s.count(x)) / 2 for x in xs]


def test_rank_tests_against_plain_versions(spark):
    rng = random.Random(3)
    rows = [(i % 2, round(rng.gauss(0.4 * (i % 2), 1), 1)) for i in range(200)]
    r = plain_ranks([x for _, x in rows])
    n1 = n0 = 100
    u = sum(a for a, (y, _) in zip(r, rows, strict=True) if y) - n1 * (n1 + 1) / 2
    xs = [x for _, x in rows]
    ties = sum(xs.count(v) ** 3 - xs.count(v) for v in set(xs))
    z = (max(u, n1 * n0 - u) - n1 * n0 / 2 - 0.5) / math.sqrt(n1 * n0 / 12 * (201 - ties / (200 * 199)))
    got = M.rank_sum(spark.createDataFrame(rows, "y int, score double")).first()
    assert got["u"] == u and got["z"] == pytest.approx(z) and got["p"] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-6)
    d = [x for x in xs if x]
    r = plain_ranks([abs(x) for x in d])
    w = min(sum(a for a, x in zip(r, d, strict=True) if x > 0), sum(a for a, x in zip(r, d, strict=True) if x < 0))
    n, ab = len(d), [abs(x) for x in d]
    ties = sum(ab.count(v) ** 3 - ab.count(v) for v in set(ab))
    z = (w - n * (n + 1) / 4) / math.sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24)
    got = M.signed_rank(spark.createDataFrame([(x,) for x in xs], "d double")).first()
    assert got["w"] == w and got["z"] == pytest.approx(z) and got["p"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-6)


def test_tests_without_rows(spark):
    none = spark.createDataFrame([], "y int, score double")
    assert M.rank_sum(none).first()["p"] is None
    assert M.signed_rank(none.select(F.col("score").alias("d"))).first()["p"] is None


def test_kolmogorov(spark):
    at = lambda x: spark.range(1).select(S.kolmogorov(F.lit(x))).first()[0]
    assert at(0.1) == 1 and at(1.0) == pytest.approx(0.2699996717, abs=1e-9) and at(3.0) == pytest.approx(2 * math.exp(-18), rel=1e-6)


def test_deletions(spark):
    d = spark.createDataFrame([('Alfa beta "Gama," delta', ["alfa", "gama"]), ("Alfa", ["alfa"]), ("", [])], "text string, top array<string>")
    n = lambda t: F.size(X.words(t)).cast("double")
    r = [tuple(x) for x in M.faithfulness(d, F.col("top"), n, (1, 2, 3)).select("drop_1", "drop_2", "drop_3", "auc").collect()]
    assert r == [(1.0, 2.0, None, 1.5), (None, None, None, 0.0), (None, None, None, 0.0)]


def test_pages(spark):
    one = lambda e, **c: spark.createDataFrame([tuple(c.values())], ", ".join(f"{k} string" for k in c)).select(e).first()[0]
    h, u = F.col("h"), F.col("u")
    assert one(html.publication_year(h), h='<meta property="article:published_time" content="1999-01-01"><time datetime="2023-05-05">') == 2023
    assert one(html.publication_year(h), h="<p>publicat 5 martie 2024 la ora</p>") == 2024
    assert one(html.publication_year(h), h="<p>fara data</p>") is None
    assert str(one(html.labelled_date(h, P.PUBLISHED, "article:published_time"), h="<b>Data publicării:</b> 05.03.2024  10:20")) == "2024-03-05 10:20:00"
    assert one(html.canonical(u), u="https://g4media.ro/a/b/?x=1") == "https://www.g4media.ro/a/b"
    assert one(html.canonical(u), u="https://m.hotnews.ro/a") == "https://m.hotnews.ro/a"
    assert one(html.is_article(u), u="https://hotnews.ro/un-slug-123456") is True
    assert one(html.is_article(u), u="https://hotnews.ro/tag/un-slug-123456") is False
    assert one(html.is_article(u), u="https://altul.ro/un-slug-123456") is False
    assert one(html.page_title(h, F.lit("listing"), "big"), h="<h1>a</h1><h1 class='x'>b</h1><h1 class=\"big x\">c</h1>") == "c"
    assert one(html.page_title(h, F.lit("listing"), "big"), h="<h1> </h1>") == "listing"


def test_listing_stops_after_two_old_pages(spark):
    probes = ["2024-09", "2024-01", None, "2024-01", "2024-09", "2024-01", "2024-02", "2024-09"]
    d = spark.createDataFrame([("a", i, p) for i, p in enumerate(probes)] + [("b", 0, "2020")], "listing string, page int, probe string")
    kept = html.listing_cutoff(d, "2024-07").collect()
    assert sorted((r["listing"], r["page"]) for r in kept) == [("a", i) for i in range(7)] + [("b", 0)]


def test_complete_joins(spark):
    ok = spark.createDataFrame([(1, 2)], "a int, b int")
    assert dedup.check_complete(ok, "b").count() == 1
    with pytest.raises(ValueError, match="rows without b"):
        dedup.check_complete(spark.createDataFrame([(1, None)], "a int, b int"), "b")
