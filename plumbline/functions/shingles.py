"""Shingle sets of many texts at once, as numpy arrays of 64-bit hashes.

The sets are those of ``similarity.word_set`` and ``char_set``, by other hashes: the two kinds must not be mixed.
Texts come lower-cased by Spark; white space is squeezed here. What counts as a letter outside ASCII is said by the JVM
as well, in ``masked``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

U64 = np.uint64
_rng = np.random.default_rng(20250611)
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, U64), np.ones(1, U64)]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_AZ = np.zeros(256, bool)
_AZ[0x61:0x7B] = True
_WORD = _AZ.copy()
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), 0x5F]] = True
#: Bytes from which a word is hashed by blake2b: a polynomial mod 2**64 has long words of equal hash.
_LONG = 24


def masked(low: Column) -> Column:
    """A lower-cased text with letters and digits outside ASCII as underscores, null where it has only ASCII: enough to find its a-z words."""
    return F.when(F.octet_length(low) > F.length(low), F.regexp_replace(low, r"[\p{L}\p{N}&&[^\x00-\x7F]]", "_"))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def _spans(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of the stretches [s, e)."""
    n = len(data) + 1
    if len(_powers[0]) < n:
        size = max(n, 1 << 21)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=U64)
    sums = np.zeros(n, U64)
    np.cumsum(_BYTES[data] * _powers[0][: n - 1], out=sums[1:])
    return mix((sums[e] - sums[s]) * _powers[1][s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null is the empty text."""
    col = col.cast(pa.large_string())
    col = col.fill_null("") if col.null_count else col
    _, off, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def chunks(batch: pa.RecordBatch, name: str, budget: int = 1 << 20):
    """(first row, last row + 1) of stretches of at most ``budget`` bytes of a text column, or of one row."""
    off = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False))])
    i, n = 0, batch.num_rows
    while i < n:
        j = min(max(int(np.searchsorted(off, off[i] + budget, "right")) - 1, i + 1), n)
        yield i, j
        i = j


def word_hashes(low: pa.Array, mask: pa.Array | None, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rows) of the words of a-z of ``least`` letters or more, in order."""
    data, off = utf8(low if mask is None else pc.coalesce(mask, low))
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    inside = _WORD[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    odd = np.concatenate([[0], np.cumsum(inside & ~_AZ[data])])
    fine = (odd[e] == odd[s]) & (e - s >= least)
    s, e = s[fine], e[fine]
    h = _spans(data, s, e)
    long_ = np.flatnonzero(e - s > _LONG)
    if len(long_):
        raw = data.tobytes()
        h[long_] = [int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8).digest(), "little") for a, b in zip(s[long_].tolist(), e[long_].tolist())]
    return h, np.searchsorted(off, s, "right") - 1


def word_grams(low: pa.Array, mask: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rows) of three words in a row of one text, repeats kept."""
    return runs_of_three(*word_hashes(low, mask))


def runs_of_three(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one = row[2:] == row[:-2] if len(row) > 2 else np.zeros(0, bool)
    return mix(mix(mix(h[:-2][one]) + h[1:-1][one]) + h[2:][one]), row[:-2][one]


def _letter_runs(data: np.ndarray, off: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rows) of the runs of a-z, whatever stands beside them."""
    return word_hashes(pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(np.where(_AZ[data], data, np.uint8(32)).tobytes())), None, least)


def letter_words(low: pa.Array, mask: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rows) of ``text.letter_words`` of over 4 letters."""
    return _letter_runs(*utf8(low), 5)


def batch_grams(low: pa.Array, mask: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rows) of three of ``text.batch_words`` in a row: everything but a-z and white space is deleted first."""
    data, off = utf8(low)
    keep = _AZ[data] | _SPACE[data]
    off = np.concatenate([[0], np.cumsum(keep)])[off]
    return runs_of_three(*_letter_runs(data[keep], off))


def char_grams(low: pa.Array, mask: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rows) of five characters in a row of one text with white space squeezed to a space, repeats kept."""
    data, off = utf8(low)
    if not len(data):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    space = _SPACE[data]
    drop = np.zeros(len(data), bool)
    drop[1:] = space[1:] & space[:-1]
    drop[off[:-1][off[:-1] < len(data)]] = False
    data = np.where(space, np.uint8(32), data)
    # places of characters, not of bytes: continuation bytes start none
    keep = ~drop
    heads = np.concatenate([[0], np.cumsum(keep & ((data & 0xC0) != 0x80))])
    c = np.frombuffer(data[keep].tobytes().decode().encode("utf-32-le"), np.uint32).astype(U64)
    ends = heads[off[1:]]
    row = np.repeat(np.arange(len(ends)), np.diff(heads[off]))
    n = len(c) - 4
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    fits = np.arange(n) + 5 <= ends[row[:n]]
    # five characters of 21 bits: 63 bits, mixed, and the other 42
    h = mix(mix(c[:n] | c[1 : n + 1] << U64(21) | c[2 : n + 2] << U64(42)) + (c[3 : n + 3] | c[4 : n + 4] << U64(21)))
    return h[fits], row[:n][fits]


def uniq(x: np.ndarray) -> np.ndarray:
    """``np.unique`` by sorting, which is several times faster than by hashing."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def distinct(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the distinct hashes of each of ``n`` rows, ascending; rows come in order."""
    if n < 1 << 16:  # by hash, then stably by row, which is a radix sort
        order = np.argsort(h)
        order = order[np.argsort(row[order].astype(np.uint16), kind="stable")]
    else:
        order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(n + 1))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + count)."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)
