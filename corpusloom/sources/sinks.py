"""Sinks: files, reports, side outputs. Reports are rendered from small results only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(d: DataFrame, path: str, columns: list[str], bom: bool = False) -> None:
    d = d.select(*columns)
    if bom:  # for spreadsheet programs: the mark precedes the first header cell of each part
        d = d.withColumnRenamed(columns[0], "﻿" + columns[0])
    d.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def parquet(d: DataFrame, path: str, by: str | None = None) -> None:
    """Parquet, in folders of a column if given, so that later reads prune them."""
    w = d.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def json_report(d: DataFrame, path: str) -> None:
    d.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def markdown(d: DataFrame, title: str, limit: int = 200) -> str:
    """A table of at most `limit` rows as Markdown; a last line says so if there are more."""
    rows = d.limit(limit + 1).collect()
    more = f"\nOnly the first {limit} rows.\n" if len(rows) > limit else ""
    rows = rows[:limit]
    head = "| " + " | ".join(d.columns) + " |\n|" + "-|" * len(d.columns) + "\n"
    return f"# {title}\n\n" + head + "".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |\n" for r in rows) + more


def attribution_html(weights: list[tuple[str, float]]) -> str:
    """Words coloured by weight (red for, blue against)."""
    import html

    top = max((abs(w) for _, w in weights), default=0) or 1
    span = lambda w, x: f'<span style="background:rgba({"255,0,0" if x > 0 else "0,0,255"},{abs(x) / top:.2f})">{html.escape(w)}</span>'
    return "<p>" + " ".join(span(w, x) for w, x in weights) + "</p>"


def with_side_output(d: DataFrame, path: str, keep) -> None:
    """All rows and those that `keep` (a column) holds for, from one computation."""
    d = d.persist()
    parquet(d, f"{path}/all")
    parquet(d.where(keep), f"{path}/kept")
    d.unpersist()
