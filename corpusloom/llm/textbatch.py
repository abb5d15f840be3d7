"""Words, lines and their hashes for whole Arrow batches of texts, by numpy on the UTF-8 bytes.

Separators are ASCII, so they can be found in the bytes; a code point is a byte that isn't a continuation
byte. A span's hash joins two polynomial hashes, each a difference of prefix sums, so no Python loop runs over words: one
modulo 2**64, which texts of a regular pattern can fool (any power of 2 can be), and one modulo the prime 2**31 - 1. Each
is shifted back by the inverse power, and both are mixed into 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_INV = pow(_P, -1, 1 << 64)
#: Bytes taken at a time; a longer text is taken whole.
CHUNK = 1 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
IS_CONT = np.zeros(256, bool)
IS_CONT[0x80:0xC0] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table_of(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars.encode("ascii"))] = True
    return t


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


#: The prime modulus and its base.
_Q, _R = U((1 << 31) - 1), 1_220_703_125


def _residues(base: int, n: int) -> np.ndarray:
    """Powers of base modulo _Q; each half is the one before it times one power."""
    out, have = np.ones(n, U), 1
    while have < n:
        k = min(have, n - have)
        out[have : have + k] = out[:k] * U(pow(base, have, int(_Q))) % _Q
        have += k
    return out


_pw: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    if not _pw or len(_pw[0]) < n:
        n = max(16, 2 * n)
        _pw[:] = [_powers(_P, n), _powers(_INV, n), _residues(_R, n), _residues(pow(_R, -1, int(_Q)), n)]
    return _pw


def mix(h: np.ndarray) -> np.ndarray:
    """Scatter the bits of unsigned 64-bit values (the finaliser of splitmix64)."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


class Batch:
    """Some texts: `data` (bytes), `off` (n + 1 offsets)."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off, self.n = data, off, len(off) - 1

    def lower(self) -> Batch:
        return Batch(LOWER[self.data], self.off)

    def spans(self, inside: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of `inside`, which also end at `cuts` (offsets)."""
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.zeros(len(inside) + 1, bool)
        at[cuts] = True
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | at[:-1]))
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:]
        return starts, np.flatnonzero(inside & (~after | at[1:])) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text index of each word."""
        s, e = self.spans(~IS_SPACE[self.data], self.off)
        return s, e, np.searchsorted(self.off, s, side="right") - 1

    def hasher(self):
        """A function of (starts, ends) that gives hashes of those spans of bytes."""
        n = len(self.data)
        pw, inv, residue, back = _tables(n + 1)
        data = self.data.astype(U) + U(1)
        total, second = np.zeros(n + 1, U), np.zeros(n + 1, U)
        np.cumsum(data * pw[:n], out=total[1:])
        np.cumsum(data * residue[:n] % _Q, out=second[1:])  # sums of residues stay under 2**64 for up to 2**33 bytes
        return lambda s, e: mix((total[e] - total[s]) * inv[s] ^ mix((second[e] - second[s]) % _Q * back[s] % _Q))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text index of each \\n-split line; an empty text has one empty line."""
        nl = np.flatnonzero(self.data == 10)
        of = np.searchsorted(self.off, nl, side="right") - 1
        ends = np.concatenate([nl, self.off[1:]])
        text = np.concatenate([of, np.arange(self.n)])
        order = np.lexsort((ends, text))
        ends, text = ends[order], text[order]
        starts = np.empty_like(ends)
        first = np.empty(len(ends), bool)
        first[:1] = True
        first[1:] = text[1:] != text[:-1]
        starts[1:] = ends[:-1] + 1
        starts[first] = self.off[text[first]]
        return starts, ends, text


def sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many flags are set in each span."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[ends] - total[starts]


def ngrams(h: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n successive words of one text, and the index of each n-gram's first word."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    g = np.full(m, n, U)
    for k in range(n):
        g *= U(0xD6E8FEB86659FD93)
        g += h[k : k + m]
    at = np.flatnonzero(of[:m] == of[n - 1 : n - 1 + m])
    return mix(g[at]), at


def chunks(col: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, Batch]]:
    """(first row, row after the last, texts) of successive parts of about CHUNK bytes; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = int(np.searchsorted(off, off[lo] + CHUNK, side="right")) - 1
        hi = min(max(hi, lo + 1), len(col), lo + 4096)
        yield lo, hi, Batch(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi
