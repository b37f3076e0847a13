"""Vectorised text kernels: Arrow string columns seen as one byte array with document offsets.

Everything works on a *chunk*: some consecutive rows of an Arrow batch, at most
``CHUNK`` bytes of text unless a single document is longer. Memory is therefore
bounded by the chunk or by the longest document, never by a partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass holds.
CHUNK = 2 << 20

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_powers = [np.ones(1, U64), np.ones(1, U64)]

#: The white space of all word rules here: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: One random 64-bit value for each byte; the second table folds A-Z onto a-z.
BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
FOLDED = BYTES.copy()
FOLDED[65:91] = BYTES[97:123]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix finaliser)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse mod 2**64."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1024)
        for i, base in enumerate((_P, _PINV)):
            p = np.full(size, base & ((1 << 64) - 1), U64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=U64)
    return _powers[0][:n], _powers[1][:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * base**i; ``spans`` reads hashes of any stretch from them."""
    n = len(values)
    out = np.zeros(n + 1, U64)
    np.cumsum(values * powers(n)[0], out=out[1:])
    return out


def spans(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches [lo, hi), equal wherever the values and the length are equal."""
    inv = powers(len(sums))[1]
    return mix((sums[hi] - sums[lo]) * inv[lo] + (hi - lo).astype(U64) * U64(0xD6E8FEB86659FD93))


#: Bytes from which a word is hashed by xxh3: a polynomial mod 2**64 has long words of equal hash, whatever its base.
LONG = 24
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, s: np.ndarray, e: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hashes of the words [s, e) of a text; with ``fold`` A-Z count as a-z."""
    h = spans(prefix((FOLDED if fold else BYTES)[data]), s, e)
    long_ = np.flatnonzero(e - s > LONG)
    if len(long_):
        from xxhash import xxh3_64_intdigest

        raw = (_LOWER[data] if fold else data).tobytes()
        h[long_] = np.fromiter((xxh3_64_intdigest(raw[a:b]) for a, b in zip(s[long_].tolist(), e[long_].tolist())), U64, len(long_))
    return h


def grams(sums: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all stretches of k values, by start."""
    n = len(sums) - 1 - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    return mix((sums[k:] - sums[:-k]) * powers(n)[1])


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column as large strings; null is the empty text."""
    col = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    return col.fill_null("") if col.null_count else col


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large-string array."""
    _, off, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def chunks(batches, name: str = "text", budget: int = 0):
    """(batch slice, bytes, offsets) of at most ``budget`` bytes each, or of one row."""
    budget = budget or CHUNK
    for batch in batches:
        col = text_column(batch, name)
        data, off = utf8(col)
        i, n = 0, len(col)
        while i < n:
            j = int(np.searchsorted(off, off[i] + budget, "right")) - 1
            j = min(max(j, i + 1), n)
            yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j


def word_spans(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets by document) of maximal runs of bytes outside ``space``."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~space[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[off[:-1][off[:-1] < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[off[1:][off[1:] > off[:-1]] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def ids_column(batch: pa.RecordBatch, name: str = "doc_id") -> np.ndarray:
    """An integer id column; null is the smallest integer."""
    col = batch.column(batch.schema.get_field_index(name)).cast(pa.int64())
    return col.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def owners(off: np.ndarray) -> np.ndarray:
    """For each item, the index of the group that the offsets put it in."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + count)."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    out = np.ones(total, np.int64)
    nz = counts > 0
    first = (ends - counts)[nz]
    s, c = starts[nz], counts[nz]
    out[0] = s[0]
    out[first[1:]] = s[1:] - (s[:-1] + c[:-1] - 1)
    return np.cumsum(out)


def sliding_min(key: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    n = len(key) - w + 1
    if n <= 0:
        return key[:0]
    m, width = key, 1
    while width * 2 <= w:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    return np.minimum(m[:n], m[w - width : w - width + n]) if width < w else m[:n]


def blobs(values) -> pa.Array:
    return pa.array([v.tobytes() if isinstance(v, np.ndarray) else v for v in values], pa.binary())


def differ(a: np.ndarray, a0: np.ndarray, b: np.ndarray, b0: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the stretches of ``size`` bytes of a from a0 and of b from b0 differ."""
    out = np.zeros(len(size), bool)
    wrong = a[ranges(a0, size)] != b[ranges(b0, size)]
    if wrong.any():
        out[np.unique(np.repeat(np.arange(len(size)), size)[wrong])] = True
    return out


class Vocabulary:
    """Numbers for byte strings: found by hash, compared byte by byte, so equal numbers are equal strings."""

    def __init__(self) -> None:
        self.keys, self.slot = np.zeros(0, U64), np.zeros(0, np.int64)
        self.at, self.long, self.body = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
        self.count = self.bytes = 0
        self.odd: dict[bytes, int] = {}  # strings that share a hash with another one met before

    def _flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        for x in (self.at, self.long, self.body):
            if len(x) > 1:
                x[:] = [np.concatenate(x)]
        return self.at[0], self.long[0], self.body[0]

    def _add(self, data: np.ndarray, s: np.ndarray, n: np.ndarray) -> np.ndarray:
        self.at.append(self.bytes + np.cumsum(n) - n)
        self.long.append(n)
        self.body.append(data[ranges(s, n)])
        self.bytes += int(n.sum())
        self.count += len(s)
        return np.arange(self.count - len(s), self.count)

    def numbers(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(number of each span, for each new number the span that shows it first)."""
        n = e - s
        h = words(data, s, e) if hashes is None else hashes
        keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        out = np.empty(len(keys), np.int64)
        out[known] = self.slot[at[known]]
        fresh = np.flatnonzero(~known)
        out[fresh] = self._add(data, s[first[fresh]], n[first[fresh]])
        shown = [first[fresh]]
        if len(fresh):
            keys2, slot2 = np.concatenate([self.keys, keys[fresh]]), np.concatenate([self.slot, out[fresh]])
            order = np.argsort(keys2, kind="stable")
            self.keys, self.slot = keys2[order], slot2[order]
        where, size, body = self._flat()
        num = out[inverse]
        bad = size[num] != n
        # what is compared with the first of its hash here need not be compared with itself
        ask = np.flatnonzero(~bad)
        ask = ask[~np.isin(ask, first[fresh], assume_unique=True)] if len(fresh) else ask
        bad[ask[differ(data, s[ask], body, where[num[ask]], n[ask])]] = True
        if bad.any():
            raw = data.tobytes()
            for i in np.flatnonzero(bad).tolist():
                key = raw[s[i] : e[i]]
                if key not in self.odd:
                    self.odd[key] = int(self._add(data, s[i : i + 1], n[i : i + 1])[0])
                    shown.append(np.array([i]))
                num[i] = self.odd[key]
        return num, np.concatenate(shown)
