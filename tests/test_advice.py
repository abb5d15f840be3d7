
import hashlib
from collections import Counter
from datetime import datetime

import pandas as pd

import __spark_entry__ as entry
from corpusloom.plans import models

from .test_queries import DATA


def run(spark, name, data=DATA):
    return entry.queries()[name](spark, data).toPandas()


def read(name):
    return pd.read_parquet(f"{DATA}/{name}.parquet")


def test_coverage_gaps_counts_every_event(spark, tmp_path):
    rows = [(1, datetime(2024, 1, 1, 5), 2, "error"), (2, datetime(2024, 1, 1, 6), 41, "error"), (3, datetime(2024, 1, 2), 1, "view"), (4, datetime(2024, 1, 3), None, "error")]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    got = run(spark, "coverage_gaps", str(tmp_path)).sort_values("day")
    assert list(got.itertuples(index=False, name=None)) == [("2024-01-01", 2, False), ("2024-01-02", 0, True), ("2024-01-03", 1, False)]
    assert run(spark, "coverage_gaps")["n"].sum() == (read("events")["event_type"] == "error").sum()


def test_encoded_documents_are_all_documents(spark, tmp_path):
    got, docs = run(spark, "encoded_documents"), read("documents")
    assert sorted(got["doc_id"]) == sorted(docs["doc_id"])
    spark.createDataFrame([(1, None), (2, ""), (3, "word " * 20000)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert dict(run(spark, "encoded_documents", str(tmp_path)).itertuples(index=False, name=None)) == {1: 0.0, 2: 0.0, 3: 1.0}


def test_lime_surrogate_makes_1000_perturbations(spark, monkeypatch):
    seen, lime = [], models.lime
    monkeypatch.setattr(models, "lime", lambda d, score, perturbations=1000, **k: seen.append(perturbations) or lime(d, score, perturbations, **k))
    assert len(run(spark, "lime_surrogate")) and seen == [1000]


def test_merge_takes_whole_tables(spark, tmp_path):
    got = run(spark, "merge_priority_dedup")
    keys = {hashlib.sha1(t.encode()).hexdigest() for n in ("documents", "benchmark") for t in read(n)["text"] if t is not None}
    assert keys <= set(got["key"]) and got["key"].is_unique and set(got["priority"]) == {0, 1, 2}
    put = lambda name, rows, cols: spark.createDataFrame(rows, cols).write.parquet(str(tmp_path / f"{name}.parquet"))
    put("documents", [(1, "a"), (None, "b"), (5, "a")], "doc_id long, text string")
    put("benchmark", [(1, "b"), (2, "c")], "item_id long, text string")
    put("pages", [(7, "<p>c</p>"), (8, "<p>d</p>")], "page_id long, html string")
    small = run(spark, "merge_priority_dedup", str(tmp_path))
    name = {hashlib.sha1(t.encode()).hexdigest(): t for t in "abcd"}
    assert sorted((name[k], p, -1 if i != i else int(i)) for i, p, k in small[["doc_id", "priority", "key"]].itertuples(index=False)) == [("a", 0, 1), ("b", 0, -1), ("c", 1, 2), ("d", 2, 8)]


def test_titles_are_whole_and_of_pages(spark, tmp_path):
    assert len(run(spark, "title_actions")) == len(read("pages"))
    long = "A title of many words that goes on and on far beyond the sixtieth character of the page"
    spark.createDataFrame([(2, f"<h1>{long}</h1>"), (3, f"<h1>{long}</h1>")], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert set(run(spark, "title_actions", str(tmp_path))["title"]) == {long}


def test_token_frequency_counts_rare_words(spark, tmp_path):
    spark.createDataFrame([(1, "one two Two"), (2, "two"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = run(spark, "token_frequency", str(tmp_path))
    assert {r.word: (r.n, r.n_docs) for r in got.itertuples()} == {"one": (1, 1), "two": (3, 2)}
