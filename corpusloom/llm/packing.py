"""Best-fit packing with several permitted sequence lengths.

Pieces (documents, those over the largest capacity cut at it) are packed by best-fit decreasing: a piece goes to
the open bin with the least room that holds it; if there is none, a bin of the capacity with the least cost
for each word that it can still be filled with is opened, its fill foreseen from the lengths that remain;
at the end each bin is cut down to the smallest capacity that holds its contents. A bin of capacity c costs
c * (1 + c / ATTENTION): what grows with its length, and attention, which grows with the square.

The packing runs over counts of pieces by length, of which there are at most max(CAPACITIES), whatever the size of
the input: bins with equal contents are a range of bin numbers, so all pieces of a length that fit bins of
one kind are placed at once. Its result is a table of ranges (piece ranks within a length to bin numbers). Ranks
are counted in slices, so a common length has no task of its own, and the packing is one for the whole input.

Cases: null or empty texts have no piece to place: one row with bin_id null and 0 words; repeated rows are packed
each; very long documents fill whole bins and a rest; columns with an output's name are replaced.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.ranking import ranked
from corpusloom.llm.shared import n_words, stash

CAPACITIES = (512, 1024, 2048)
ATTENTION = 8192


def foreseen(room: int, size: int, lengths: list[int], left: dict[int, int]) -> int:
    """Words that a bin with this room can hold, taking a piece of `size`, then the longest that fit."""
    used, at = 0, size
    while at:
        k = min(left[at], room // at)
        used, room = used + k * at, room - k * at
        i = bisect.bisect_right(lengths, min(room, at - 1)) - 1
        at = lengths[i] if i >= 0 else 0
    return used


def pack_counts(counts: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, attention: int = ATTENTION) -> tuple[list[tuple[int, int, int, int, int, int]], list[tuple[int, int, int]]]:
    """counts of pieces by length -> (placements, bins).

    placements: (length, first rank, first bin, bins, pieces in each, words in each bin before them); bins: (first bin, bins, capacity).
    """
    capacities = tuple(sorted(capacities))
    lengths = sorted(n for n in counts if counts[n] > 0)
    left = {n: counts[n] for n in lengths}
    open_: dict[int, list[tuple[int, int, int]]] = {}  # room -> ranges (first bin, bins, capacity)
    rooms: list[int] = []
    placements, bins_made = [], 0

    def put(room: int, rng: tuple[int, int, int]) -> None:
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append(rng)

    for size in reversed(lengths):
        rank, todo = 0, left[size]
        while todo:
            i = bisect.bisect_left(rooms, size)
            if i < len(rooms):
                room = rooms[i]
                first, n, cap = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
            else:
                fits = [c for c in capacities if c >= size]
                cap = min(fits, key=lambda c: (c * (1 + c / attention) / foreseen(c, size, lengths, left), c))
                room, first, n = cap, bins_made, -(-todo // (cap // size))
                bins_made += n
            each = room // size  # all go to the bin with the least room, which stays the same bin
            full = min(n, todo // each)
            if full:
                placements.append((size, rank, first, full, each, cap - room))
                put(room - each * size, (first, full, cap))
                rank, todo = rank + full * each, todo - full * each
            if full < n:
                if todo:
                    placements.append((size, rank, first + full, 1, todo, cap - room))
                    put(room - todo * size, (first + full, 1, cap))
                    rank, todo, full = rank + todo, 0, full + 1
                if full < n:
                    put(room, (first + full, n - full, cap))
        left[size] = 0
        lengths.pop()
    bins = []
    for room, ranges in open_.items():
        for first, n, cap in ranges:
            bins.append((first, n, next(c for c in capacities if c >= cap - room)))
    return placements, sorted(bins)



def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, attention: int = ATTENTION, seed: int = 7) -> DataFrame:
    """(doc_id, piece, first_word, n_words, bin_id, bin_capacity, bin_offset): where each piece of each row goes."""
    largest = max(capacities)
    rows = docs.select("doc_id", n_words(F.col("text")).alias("words"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("_h"))
    last = F.floor((F.greatest(F.col("words"), F.lit(1)) - 1) / largest)
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    pieces = pieces.withColumn("first_word", F.col("piece") * largest).withColumn("n_words", F.least(F.lit(largest).cast("long"), F.col("words") - F.col("first_word"))).drop("words")
    pieces = stash(pieces, "pieces")
    counts = pieces.where("n_words > 0").groupBy("n_words").count().toArrow()  # at most max(capacities) rows
    placements, bins = pack_counts(dict(zip(counts["n_words"].to_pylist(), counts["count"].to_pylist(), strict=True)), capacities, attention)
    starts = [b[0] for b in bins]
    table: dict[int, list[tuple]] = {}
    for size, rank, first, n, each, used in placements:
        done = first
        while done < first + n:  # a range of bins that were filled alike may end at several capacities
            f, k, cap = bins[bisect.bisect_right(starts, done) - 1]
            end = min(first + n, f + k)
            table.setdefault(size, []).append((rank + (done - first) * each, done, each, used, cap))
            done = end
    found = {s: [np.array(c, np.int64) for c in zip(*sorted(v), strict=True)] for s, v in table.items()}

    def place(batches):
        for pdf in batches:
            out = pdf[["doc_id", "piece", "first_word", "n_words"]].copy()
            size, rank = pdf["n_words"].to_numpy(), pdf["rank"].to_numpy()
            where, cap, off = np.full(len(pdf), -1, np.int64), np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for s in np.unique(size[size > 0]):
                m = np.flatnonzero(size == s)
                r0, b0, each, used, c = found[int(s)]
                i = np.searchsorted(r0, rank[m], side="right") - 1
                k = rank[m] - r0[i]
                where[m], cap[m], off[m] = b0[i] + k // each[i], c[i], used[i] + (k % each[i]) * s
            out["bin_id"], out["bin_capacity"], out["bin_offset"] = where, cap, off
            yield out

    schema = "doc_id long, piece long, first_word long, n_words long, bin_id long, bin_capacity long, bin_offset long"
    out = ranked(pieces, ["n_words"], F.xxhash64("_h", "piece"), ["doc_id", "piece"]).mapInPandas(place, schema)
    empty = F.col("n_words") == 0
    return out.select("doc_id", "piece", "first_word", "n_words", *[F.when(~empty, F.col(c)).alias(c) for c in ("bin_id", "bin_capacity", "bin_offset")])
