"""Connected components of links between ids, by repeated contraction; every step is a join or an aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import SMALL_ROWS, lookup, stash, unstash


def components(links: DataFrame) -> DataFrame:
    """links: stored table (a, b). Returns stored (id, label) of every id in a link; label: least id of its component.

    In each round every id points to the first of itself and its neighbours, pointers are followed once more, and
    links are renamed to where their ends point; those that have become loops go. First is the least id in even
    rounds, which ends stars around their least id at once, and the least of a hash that changes with the round in
    odd ones: a chain, whatever the order of its ids, loses a share of its nodes in each of these, so rounds grow as log n. Nothing is collected; a hub's links are summed within tasks before they are dealt, and
    joins look ids up with their counts (shared.lookup), so a hub is no task of its own.
    """
    edges = links.where("a <> b").select("a", "b")
    labels, spent, ends, turn = None, [], 2 * edges.count(), 0
    while True:
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h") if turn % 2 else F.lit(0).cast("long").alias("h"), F.col(c).alias("id"))  # noqa: E731, B023
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stash(both.groupBy("a").agg(F.min(rank("b")).alias("b"), F.count("*").alias("links")).select(F.col("a").alias("id"), F.least(rank("a"), F.col("b"))["id"].alias("to"), "links"), "least")
        step = lookup(least, least.select(F.col("id").alias("to"), F.col("to").alias("top"), F.col("links").alias("n")), ["to"], "n", "left", ends, ends)
        up = stash(step.select("id", F.coalesce("top", "to").alias("to"), "links"), "up")
        if labels is None:
            new = stash(up.select("id", F.col("to").alias("label")), "labels")
        else:
            known = labels.groupBy("label").agg(F.count("*").alias("n")).join(up.select(F.col("id").alias("label"), "to"), "label")
            if ends > SMALL_ROWS:
                known = stash(known, "known")
                spent.append(known)
            new = stash(lookup(labels, known, ["label"], "n", "left", most=ends).select("id", F.coalesce("to", "label").alias("label")), "labels")
        end = lambda c: up.select(F.col("id").alias(c), F.col("to").alias(f"t{c}"), F.col("links").alias("n"))
        renamed = lookup(lookup(edges, end("a"), ["a"], "n", "inner", ends, ends), end("b"), ["b"], "n", "inner", ends, ends)
        after = stash(renamed.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        unstash(up, least, *spent)
        labels, edges, spent, ends = new, after, [new, after], 2 * after.count()
        turn += 1
        if not ends:
            break
    least = labels.groupBy("label").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    out = stash(lookup(labels, stash(least, "least"), ["label"], "n", "inner").select("id", F.col("least").alias("label")), "labels")
    unstash(labels, after)
    return out
