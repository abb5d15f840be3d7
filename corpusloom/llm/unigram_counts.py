"""Token counts: how many pieces a unigram tokenizer's best segmentation of a text has, without making the pieces.

An Aho-Corasick automaton lists all vocabulary matches of a word; dynamic programming over their ends carries
the best score (double, as the tokenizer adds them up) and its number of pieces. Tie rules are those of the
tokenizers library's unigram model: of equal scores the match that starts first wins; a character that no
piece of its own covers may stand alone for the least score less 10; successive unknown characters are one
piece, or (byte fallback) as many as their bytes if all byte pieces exist.

Words are cut at blanks first (the tokenizer's Metaspace rule: blanks become U+2581, one before each word), so
equal words have equal counts, which are kept for the CACHE latest words of a task: memory stays bounded.
The vocabulary is a file outside the repository (parameter); its scores are used as they are.

Cases: null and empty texts have 0 tokens; a text of blanks has a piece sequence of its own; repeated rows get
equal counts; columns with an output's name are replaced.
"""

from __future__ import annotations

import os

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusloom.llm.arrowmap import append, field

VOCABULARY = os.environ.get("UNIGRAM_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
#: Words that a task keeps, and the longest of them in characters.
CACHE, LONG = 1 << 18, 64


def vocabulary(path: str) -> tuple[list[tuple[str, float]], int, bool]:
    """(pieces with scores, id of the unknown piece, byte fallback) of a sentencepiece model file."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())]
    return pieces, m.unk_id(), any(m.is_byte(i) for i in range(m.get_piece_size()))


class Counter:
    """Counts pieces of words; made once in each Python worker."""

    def __init__(self, pieces: list[tuple[str, float]], unk: int, byte_fallback: bool):
        self.scores = ahocorasick.Automaton()
        for i, (p, s) in enumerate(pieces):
            if p and i != unk:
                self.scores.add_word(p, (len(p), s))
        self.scores.make_automaton()
        self.least = min(s for _, s in pieces) - 10.0
        names = {p for p, _ in pieces}
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in names for b in range(256))
        self.seen: dict[str, int] = {}

    def word(self, w: str) -> int:
        n = self.seen.get(w)
        if n is None:
            if len(w) > LONG:
                return self.count(w)
            if len(self.seen) >= CACHE:
                self.seen.clear()
            n = self.seen[w] = self.count(w)
        return n

    def count(self, w: str) -> int:
        """Viterbi over w, whose unknown characters count as the fallback says."""
        n = len(w)
        by_start: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, (size, score) in self.scores.iter(w):
            by_start[end + 1 - size].append((end + 1, score))
        best: list[float | None] = [None] * (n + 1)
        pieces, open_unk = [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        for at in range(n):
            base, single = best[at], False
            if base is None:
                continue
            for end, score in by_start[at]:
                single |= end == at + 1
                s = base + score
                if best[end] is None or s > best[end]:
                    best[end], pieces[end], open_unk[end] = s, pieces[at] + 1, False
            if not single:
                s = base + self.least
                if best[at + 1] is None or s > best[at + 1]:
                    best[at + 1] = s
                    more = len(w[at].encode()) if self.bytes else 0 if open_unk[at] else 1
                    pieces[at + 1], open_unk[at + 1] = pieces[at] + more, True
        return pieces[n]

    def text(self, t: str) -> int:
        if not t:
            return 0
        t, word = t.replace(MARK, " "), self.word
        return sum([word(MARK + w) for w in t.split(" ")]) if t[0] != " " else sum([word(MARK + w) for w in t[1:].split(" ")])


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """docs with `n_tokens`."""
    text = docs.columns.index("text")
    pieces, unk, fallback = vocabulary(path)  # read on the driver, so executors need no file
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((pieces, unk, fallback))  # as large as the vocabulary

    def make(batch: pa.RecordBatch) -> list:
        c = _counters.get(path) or _counters.setdefault(path, Counter(*shared.value))
        col = batch.column(text)
        return [pa.array(np.fromiter((c.text(t) if t else 0 for t in (x.as_py() for x in col)), np.int64, len(col)), pa.int64())]

    return append(docs, [field("n_tokens", T.LongType())], make)
