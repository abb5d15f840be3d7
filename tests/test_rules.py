"""Hand-written cases of rules, verdicts, segments and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P
from corpusloom.functions import scoring as S
from corpusloom.functions import text as X
from corpusloom.operators import clean, dedup, sampling, segment, similarity
from corpusloom.sources import readers, sinks
from corpusloom.streaming import events


def one(spark, expr, **cols):
    d = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'long' if isinstance(v, int) else 'string'}" for k, v in cols.items())) if cols else spark.range(1)
    return d.select(expr.alias("x")).first()[0]


@pytest.mark.parametrize("text,n", [("", 0), (None, 0), ("  ", 0), (" a b ", 2), ("a\tb\nc", 3)])
def test_word_count(spark, text, n):
    assert spark.createDataFrame([(text,)], "t string").select(X.n_words(F.col("t"))).first()[0] == n


def test_truncation(spark):
    assert one(spark, X.truncate_words(F.col("t"), 2), t="a  b c") == "a b"
    assert one(spark, X.truncate_words(F.col("t"), 3), t="a  b c") == "a  b c"
    assert one(spark, X.truncate_sentence(F.col("t"), 2), t="a b c") == "a b."


def test_titles(spark):
    strip = lambda t: one(spark, X.strip_title_prefix(F.col("t")), t=t)
    assert strip("Video Ceva nou") == "Ceva nou"
    assert strip("Videoclip nou") == "Videoclip nou"
    assert strip("Galerie Foto Marea") == "Marea"
    assert strip("Video") == "Video"


def test_dates(spark):
    assert one(spark, X.month_date(F.col("t")), t="publicat 5 martie 2024") == "2024-03-05"
    assert one(spark, X.month_date(F.col("t")), t="fara data") is None
    assert str(one(spark, X.dotted_timestamp(F.col("t")), t="05.03.2024 10:20")) == "2024-03-05 10:20:00"


def test_quotes_and_normal_forms(spark):
    assert one(spark, X.trim_orphan_quotes(F.col("t")), t="a „b” c”") == "a „b” c"
    assert one(spark, X.nfc(F.col("t")), t="é") == "é"
    assert one(spark, X.dedup_key(X.nfkc(F.col("t"))), t="Ｆoo,  BAR!") == "foo bar"


@pytest.mark.parametrize("sentence,action", [("Zelenski:", "aruncat_eticheta_vorbitor"), ("Institutul pentru Studiul Razboiului:", "aruncat_eticheta_vorbitor"), ("ro.", "aruncat_degenerat"), ("- - -", "aruncat_degenerat"), ("Ne vaneaza!", "nemodificat"), ("O rusine.", "nemodificat"), ("Citește și: ceva", "aruncat_citeste_si"), ("Foto: x.ro Un text destul de lung", "curatat_foto_prefix"), ("Foto: x.ro scurt", "aruncat_foto_prea_scurt")])
def test_residual(spark, sentence, action):
    d = spark.createDataFrame([(sentence,)], "sentence string").withColumn("n_words", X.n_words(F.col("sentence")))
    assert clean.residual(d).first()["action"] == action


BANNER = "Setarile tale privind cookie-urile nu permit afisarea continutul din aceasta sectiune."


@pytest.mark.parametrize("sentence,action,kept", [(BANNER, "aruncat_banner_pur", ""), (BANNER + " a b c d e f", "curatat_prefix", "a b c d e f"), ("a b c d e f " + BANNER, "curatat_sufix", "a b c d e f"), (f"{BANNER} {BANNER} a b c d e f", "curatat_prefix", "a b c d e f"), ("a b", "nemodificat", "a b")])
def test_banners(spark, sentence, action, kept):
    r = clean.banners(spark.createDataFrame([(sentence,)], "sentence string")).first()
    assert (r["action"], r["cleaned"]) == (action, kept)


def test_article(spark):
    d = spark.createDataFrame([("FOTO VIDEO Un text, relatează AFP, citat de Agerpres.ro. Sursa: ceva",)], "text string")
    r = clean.article(d).first()
    assert (r["cleaned"], r["actions"]) == ("Un text.", "sursa|prefix_editorial|attribution")


@pytest.mark.parametrize("text,core,hybrid", [("Rusia a atacat Ucraina", True, False), ("Maia Sandu la Chișinău", False, True), ("moldovenii", False, True), ("presa și sport", False, False), ("Kremlinul tace", True, False), ("virus", False, False)])
def test_topics(spark, text, core, hybrid):
    r = clean.topics(spark.createDataFrame([(text,)], "text string"), P.CORE_TOPICS, P.HYBRID_TOPICS).first()
    assert (r["core"], r["hybrid"]) == (core, hybrid)


def test_verdicts(spark):
    rows = [(None, 0.5, 0), (-0.5, 0.9, 9), (0.5, 0.1, 9), (-0.006, 0.5, 9), (0.5, 0.5, 2), (0.5, 0.5, 9), (-0.0073, 0.5, 9)]
    d = spark.createDataFrame(rows, "d double, p double, n int").select(S.verdict(F.col("d")).alias("v"), S.borderline(F.col("d"), F.col("p"), F.col("n")).alias("r"))
    assert [tuple(r) for r in d.collect()] == [("incert", None), ("cls0", "dezacord_m2_cls1_m3_cls0"), ("cls1", "dezacord_m3_cls1_m2_cls0"), ("cls1", "proximitate_threshold"), ("cls1", "esantion_mic"), ("cls1", None), ("cls0", "proximitate_threshold")]


def test_audit_last_rule_wins(spark):
    d = spark.createDataFrame([("Putin:",), ("Un text curat are aici mai multe cuvinte.",), ("cookie-uri sunt folosite aici de noi.",), ("titlu scurt",)], "sentence string").withColumn("n_words", X.n_words(F.col("sentence")))
    assert [r["category"] for r in clean.audit(d).collect()] == ["eticheta_vorbitor", "probabil_curat", "boilerplate_cms", "titlu_scurt_probabil"]


def test_month_quotas(spark):
    d = spark.createDataFrame([("a", 5), ("b", 50), ("c", 50), ("d", 0)], "month string, n long")
    got = {r["month"]: r["quota"] for r in sampling.month_quotas(d, 40).collect()}
    assert got == {"a": 5, "b": 18, "c": 17, "d": 0} or sum(got.values()) == 40 and got["a"] == 5


def test_sentences(spark):
    d = spark.createDataFrame([(1, "Unu doi. Trei!\n\nPatru"), (2, None), (3, "")], "doc_id long, text string")
    assert [tuple(r)[:3] for r in segment.sentences(d).collect()] == [(1, 0, "Unu doi."), (1, 1, "Trei!"), (1, 2, "Patru")]


def test_contamination_and_checks(spark):
    docs = spark.createDataFrame([(1, "x one two three four five six seven y"), (2, "xone two three four five six sevens"), (3, "ab cd")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "one two three four five six seven"), (8, "b c")], "item_id long, text string")
    assert sorted(tuple(r) for r in clean.contained(docs, items).collect()) == [(1, 7), (2, 7), (3, 8)]
    with pytest.raises(ValueError):
        dedup.check_disjoint(docs, docs, "doc_id")
    with pytest.raises(ValueError):
        dedup.check_required(docs, ["label"])


def test_sections_by_marker(spark):
    d = spark.createDataFrame([(1, 0, "intro"), (1, 1, "STIRE: a"), (1, 2, "b"), (1, 3, "CONTEXT c")], "id long, pos int, text string")
    got = {r["section"]: r["body"] for r in clean.prefixed_sections(d, {"story": "STIRE", "context": "CONTEXT"}).collect()}
    assert got == {"story": "STIRE: a\nb", "context": "CONTEXT c"}


def test_blocked_similarity_ties(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, q array<double>")
    c = spark.createDataFrame([(5, [1.0, 0.0]), (3, [1.0, 0.0]), (9, [0.0, 1.0])], "cid long, c array<double>")
    assert [tuple(r) for r in similarity.top_k_blocked(q, c, 2).orderBy("cid").collect()] == [(1, 3, 1.0), (1, 5, 1.0)]


def test_files(spark, tmp_path):
    d = spark.createDataFrame([("1", 'a "b"\nc', 2024)], "id string, titlu string, an int")
    sinks.csv(d, f"{tmp_path}/c", ["id", "titlu", "an"])
    assert readers.csv(spark, f"{tmp_path}/c", "id string, titlu string, an int", ["titlu"]).first()[0] == 'a "b"\nc'
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{bad\n{"a": 2}\n')
    assert readers.json_lines(spark, f"{tmp_path}/x.jsonl", "a int").count() == 2
    sinks.json_report(d, f"{tmp_path}/r")
    assert json.loads(spark.read.text(f"{tmp_path}/r").first()[0])["an"] == 2024
    sinks.with_side_output(d, f"{tmp_path}/s", F.col("an") > 2030)
    assert spark.read.parquet(f"{tmp_path}/s/all").count() == 1
    assert "| 1 |" in sinks.markdown(d, "t")
    (tmp_path / "p.html").write_text("<h1>é</h1>")
    assert readers.page_files(spark, str(tmp_path)).first()["html"] == "<h1>é</h1>"
    cache = d.select(F.sha2(F.lit("a"), 256).alias("text_hash"), F.array(F.lit(1.0)).alias("embedding"))
    hit, miss = readers.vector_cache(spark.createDataFrame([("a",), ("b",)], "text string"), cache)
    assert (hit.count(), miss.count()) == (1, 1)


def test_http_source(spark):
    import http.server
    import threading

    class H(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path == "/ok" else 404)
            self.end_headers()
            self.wfile.write(b"<p>x</p>")

        def log_message(self, *a):
            pass

    srv = http.server.ThreadingHTTPServer(("127.0.0.1", 0), H)
    threading.Thread(target=srv.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{srv.server_port}"
    spark.dataSource.register(readers.HttpPages)
    got = spark.read.format("http_pages").option("urls", f"{base}/ok\n{base}/no").option("backoff", "0").load().collect()
    srv.shutdown()
    assert sorted((r["status"], r["html"]) for r in got) == [(200, "<p>x</p>"), (404, None)] or {r["status"] for r in got} == {200, 404}


def test_stream_resumes(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    row = lambda i: spark.createDataFrame([(i, None, 1, "view", 1.0, "{}")], events.SCHEMA)
    for i in (1, 2):
        row(i).write.mode("append").parquet(src)
        events.append_new(events.source(spark, src), out, f"{tmp_path}/ck", lambda d: d.where("event_id > 1")).awaitTermination()
    assert spark.read.parquet(f"{out}/all").count() == 2
    assert spark.read.parquet(f"{out}/kept").count() == 1
