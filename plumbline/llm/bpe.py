"""Byte-level BPE by dynamic programming over prefixes, and its inverse.

For each prefix of a piece exactly one token can be the last one of the
prefix's encoding: a token that fits at the end is valid if, after the last
token of the rest, BPE would leave the two apart. So one pass stores each
prefix's last token, and the encoding of any prefix is read by walking back.
An append computes new prefixes only; an edit keeps the prefixes before it.

Texts are split into pieces by byte and character classes, as the pattern of the
rank files does. Distinct pieces are encoded a chunk at a time, the same prefix of
all of them at once (``Batch``); a worker process keeps pieces with their ids over its tasks,
within the bounds of ``tokens``.

Defined results: null text is empty and has no tokens; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
import os
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernels as K, tokens

_INF = 1 << 60
_ASIS, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3
#: The code points that \\s stands for in the pattern.
_WHITE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_classes: list[np.ndarray] = []
#: So few pieces are finished one by one; bytes of pieces that are encoded at once (a longer one alone); ids that are spelled at once.
_FEW, _ROOM, _BLOCK = 8, 1 << 18, 1 << 18


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PrefixBpe:
    """Encodes byte strings by ranks; ``last`` tables are plain lists so that callers can keep and extend them."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        #: the two tokens that a token is merged from, None for bytes; tokens that merges can't reach are missing
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.memo: dict[tuple[int, int], bool] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.parts[rank] = None
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                halves = self._halves(token, rank)
                if halves:
                    self.parts[rank] = halves

    def _halves(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The split into two earlier tokens, each reachable, that merges leave apart until ``rank``."""
        for i in range(1, len(token)):
            a, b = self.ranks.get(token[:i], _INF), self.ranks.get(token[i:], _INF)
            if (a < rank or i == 1) and (b < rank or i == len(token) - 1) and a in self.parts and b in self.parts and self.apart(a, b, rank):
                return a, b
        return None

    def apart(self, a: int, b: int, before: int = _INF) -> bool:
        """Whether BPE of the bytes of a and b, with merges of rank under ``before``, ends in a, b.

        Seen backwards in time, a and b fall into their halves, the later made
        first. The two are left apart if the tokens that face each other never
        could merge sooner than the merge that was taken; of equal ranks the left one comes first.
        """
        key = (a, b)
        if before == _INF:
            known = self.memo.get(key)
            if known is not None:
                return known
        limit, x, y = before, a, b
        ok = True
        while True:
            r = self.ranks.get(self.bytes_of[x] + self.bytes_of[y])
            if r is not None and r < limit:
                ok = False
                break
            hx, hy = self.parts[x], self.parts[y]
            if hx is None and hy is None:
                break
            if hx is None or (hy is not None and y >= x):
                limit, y = y + 1, hy[0]
            else:
                limit, x = x, hx[1]
        if before == _INF:
            if len(self.memo) > 1_000_000:
                self.memo.clear()
            self.memo[key] = ok
        return ok

    def extend(self, text: bytes, last: list[int]) -> list[int]:
        """Fills ``last`` (last[i]: last token of text[:i + 1]) up to the whole of ``text``; what it holds already is kept."""
        ranks, parts, longest = self.ranks, self.parts, self.longest
        for i in range(len(last) + 1, len(text) + 1):
            for n in range(min(i, longest), 0, -1):
                t = ranks.get(text[i - n : i])
                if t is not None and t in parts and (n == i or self.apart(last[i - n - 1], t)):
                    last.append(t)
                    break
            else:
                raise ValueError(f"no token for byte {text[i - 1]}")
        return last

    def walk(self, last: list[int]) -> list[int]:
        """The tokens of the prefix that ``last`` ends with."""
        out, i = [], len(last)
        while i:
            t = last[i - 1]
            out.append(t)
            i -= len(self.bytes_of[t])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        t = self.ranks.get(piece)
        return [t] if t is not None else self.walk(self.extend(piece, []))

    def edit(self, text: bytes, last: list[int], at: int, removed: int, added: bytes) -> tuple[bytes, list[int]]:
        """(new text, its table) after an edit: prefixes before the edit keep their tokens.

        Behind the edit the old table is taken over from the first place where as
        many last tokens as the longest token has bytes are what they were.
        """
        new = text[:at] + added + text[at + removed :]
        shift = len(added) - removed
        table, same = last[:at], 0
        while len(table) < len(new):
            self.extend(new[: len(table) + 1], table)
            old = len(table) - 1 - shift
            if len(table) > at + len(added) and 0 <= old < len(last) and table[-1] == last[old]:
                same += 1
                if same >= self.longest:
                    table += last[old + 1 :]
            else:
                same = 0
        return new, table

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    if not _classes:
        table = np.fromiter((unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)), "U1", sys.maxunicode + 1)
        out = np.where(table == "L", _LETTER, np.where(table == "N", _NUMBER, _ASIS)).astype(np.uint8)
        out[list(_WHITE)] = _SPACE
        _classes.append(out)
    return _classes[0]


def pieces(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte starts of the pattern's matches, offsets by document); matches follow one another without a gap."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    table = classes()
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = data[lead]
    cls = table[:256][first]
    wide = np.flatnonzero(first >= 0xC2)
    if len(wide):
        p = np.concatenate([data, np.zeros(3, np.uint8)])
        b = [p[lead[wide] + i].astype(np.int64) for i in range(4)]
        cp = np.where(b[0] < 0xE0, (b[0] & 31) << 6 | b[1] & 63, np.where(b[0] < 0xF0, (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63, (b[0] & 7) << 18 | (b[1] & 63) << 12 | (b[2] & 63) << 6 | b[3] & 63))
        cls[wide] = table[np.minimum(cp, sys.maxunicode)]
    m = len(lead)
    edge = np.searchsorted(lead, off)  # documents in characters
    new_doc = np.zeros(m + 1, bool)
    new_doc[edge] = True
    run = np.ones(m + 1, bool)
    run[1:m] = cls[1:] != cls[:-1]
    run |= new_doc
    begin = np.flatnonzero(run)  # of runs of one class, and the end
    kind = cls[begin[:-1]]
    stop = begin[1:]
    start = np.zeros(m + 1, bool)
    blank = np.zeros(m + 1, bool)
    blank[1:] = (first == 0x20) & ~new_doc[1:]  # the character before is a space of the same document
    other = kind != _SPACE
    start[begin[:-1][other]] = ~blank[begin[:-1][other]]
    start[begin[:-1][~other]] = True
    inner = ~other & ~new_doc[stop]
    start[stop[inner] - 1] = True
    # contractions: an apostrophe that begins a match of its own, with letters behind it
    q = begin[:-1][(kind == _ASIS) & (stop - begin[:-1] == 1)]
    q = q[(first[q] == 39) & start[q] & (q + 1 < m)]
    q = q[~new_doc[q + 1]]
    q = q[cls[q + 1] == _LETTER]
    if len(q):
        padded = np.concatenate([first, np.zeros(3, np.uint8)])
        one, two = padded[q + 1], padded[q + 2]
        two = np.where((q + 2 < m) & ~new_doc[np.minimum(q + 2, m)], two, 0)
        short = np.isin(one, [ord("s"), ord("t"), ord("m"), ord("d")])
        long_ = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for mask, size in ((short, 2), (long_, 3)):
            at = q[mask]
            start[at + 1] = False
            rest = at + size
            start[rest[rest < m]] |= True  # letters left over begin a match; anything else begins one anyway, unless a space joins it
    start[edge[:-1][edge[:-1] < m]] = True
    s = np.flatnonzero(start[:m])
    return lead[s], np.searchsorted(s, edge)


class Batch:
    """The tables of ``PrefixBpe`` as arrays: encodes many pieces at once, one prefix of all of them after the other."""

    def __init__(self, bpe: PrefixBpe) -> None:
        self.bpe = bpe
        top = max(bpe.bytes_of, default=0) + 1
        self.size = np.zeros(top, np.int64)
        self.left, self.right = np.full(top, -1, np.int64), np.full(top, -1, np.int64)
        self.reach = np.zeros(top, bool)
        for t, halves in bpe.parts.items():
            self.reach[t] = True
            if halves:
                self.left[t], self.right[t] = halves
        # a trie of all tokens; nodes with children come first and have a row of next nodes, node 0 is nowhere, node 1 the root
        inner = {b""}
        for token in bpe.ranks:
            inner.update(token[:i] for i in range(1, len(token)))
        number = {x: i for i, x in enumerate(sorted(inner), 1)}
        self.inner = len(number) + 1
        for token in bpe.ranks:
            number.setdefault(token, len(number) + 1)
        self.next = np.zeros((self.inner, 256), np.int32)
        self.token = np.full(len(number) + 1, -1, np.int64)
        for x, i in number.items():
            if x:
                self.next[number[x[:-1]], x[-1]] = i
        pairs = {}
        for token, rank in bpe.ranks.items():
            self.size[rank] = len(token)
            self.token[number[token]] = rank
            for i in range(1, len(token)):
                a, b = bpe.ranks.get(token[:i]), bpe.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a * top + b] = rank
        self.top = top
        self.pair = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.pair.tolist()], np.int64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self._hash(self.pair)] = True

    @staticmethod
    def _hash(key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).view(np.int64)

    def _merge(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rank of the token that x and y would make."""
        key = x * self.top + y
        out = np.full(len(key), _INF)
        ask = np.flatnonzero(self.maybe[self._hash(key)])
        if len(ask):
            key = key[ask]
            at = np.searchsorted(self.pair, key)
            at[at == len(self.pair)] = 0
            out[ask] = np.where(self.pair[at] == key, self.merged[at], _INF)
        return out

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """``PrefixBpe.apart`` of many pairs."""
        ok = np.ones(len(x), bool)
        who, limit = np.arange(len(x)), np.full(len(x), _INF)
        while len(who):
            bad = self._merge(x, y) < limit
            ok[who[bad]] = False
            hx, hy = self.right[x], self.left[y]
            go = np.flatnonzero(~bad & ((hx >= 0) | (hy >= 0)))
            who, x, y, hx, hy = who[go], x[go], y[go], hx[go], hy[go]
            second = (hx < 0) | ((hy >= 0) & (y >= x))
            limit = np.where(second, y + 1, x)
            x, y = np.where(second, x, hx), np.where(second, hy, y)
        return ok

    def encode(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces [s, e), one after the other, and how many each has)."""
        n = e - s
        body = data[K.ranges(s, n)]
        base = np.cumsum(n) - n
        stop = np.repeat(base + n, n)
        # tokens by the place where they end, longest first
        found, whole = [], np.full(len(n), -1, np.int64)
        piece = np.repeat(np.arange(len(n)), n)
        at, node = np.arange(len(body)), np.ones(len(body), np.int32)
        count = np.zeros(len(body), np.int64)
        while len(at):
            k = len(found)
            node = self.next[node, body[at + k]]
            t = self.token[node]
            hit = np.flatnonzero(t >= 0)
            p, t = at[hit], t[hit]
            entire = (p == base[piece[p]]) & (p + k + 1 == stop[p])
            whole[piece[p[entire]]] = t[entire]
            hit = self.reach[t]
            found.append((p[hit] + k, t[hit]))
            count[p[hit] + k] += 1
            go = (node > 0) & (node < self.inner)
            at, node = at[go], node[go]
            go = at + k + 1 < stop[at]
            at, node = at[go], node[go]
        free = np.cumsum(count) - count
        token = np.zeros(int(count.sum()), np.int64)
        for ends, t in reversed(found):
            token[free[ends]] = t
            free[ends] += 1
        first = free - count
        last = np.full(len(body), -1, np.int64)
        last[(base + n - 1)[whole >= 0]] = whole[whole >= 0]
        todo = np.flatnonzero(whole < 0)
        i = 0
        while True:
            todo = todo[n[todo] > i]
            if len(todo) < _FEW:
                break
            end = base[todo] + i
            choice = first[end]
            while len(end):
                if (choice == free[end]).any():
                    raise ValueError(f"no token for byte {body[end[choice == free[end]][0]]}")
                t = token[choice]
                before = end - self.size[t]
                fits = before < base[piece[end]]
                ask = np.flatnonzero(~fits)
                fits[ask] = self.apart(last[before[ask]], t[ask])
                last[end[fits]] = t[fits]
                end, choice = end[~fits], choice[~fits] + 1
            i += 1
        for j in todo.tolist():  # few and long
            a, z = int(base[j]), int(base[j] + n[j])
            last[a:z] = self.bpe.extend(body[a:z].tobytes(), last[a : a + i].tolist())
        kept = np.zeros(len(body), bool)
        end = base + n - 1
        low = base
        while len(end):
            kept[end] = True
            end = end - self.size[last[end]]
            go = end >= low
            end, low = end[go], low[go]
        return last[kept].astype(np.uint32), np.diff(np.concatenate([[0], np.cumsum(kept)])[np.append(base, len(body))])


class Pieces(tokens.PieceEncoder):
    """Distinct pieces of texts with their ids, and what ids are as text and as bytes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__(None)
        bpe = PrefixBpe(ranks)
        self.batch = Batch(bpe)
        every = range(self.batch.top)
        self.named = self._laid([b",%d" % t for t in every])
        self.plain = self._laid([bpe.bytes_of.get(t, b"") for t in every])

    @staticmethod
    def _laid(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.array([len(x) for x in strings], np.int64)
        return np.frombuffer(b"".join(strings), np.uint8), np.cumsum(size) - size, size

    def fresh(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = np.cumsum(e - s)
        flat, n, i = [], [], 0
        while i < len(s):
            j = int(np.searchsorted(total, total[i] - (e[i] - s[i]) + _ROOM, "right"))
            if j > i:
                ids, size = self.batch.encode(data, s[i:j], e[i:j])
            else:
                j = i + 1
                ids = np.array(self.batch.bpe.encode(data[s[i] : e[i]].tobytes()), np.uint32)
                size = np.array([len(ids)])
            flat.append(ids)
            n.append(size)
            i = j
        return np.concatenate(flat), np.concatenate(n)


def sha256(ids: np.ndarray, ptr: np.ndarray, strings: tuple[np.ndarray, np.ndarray, np.ndarray], skip: int = 0) -> list[str]:
    """By document, lowercase hex of the digest of its ids' strings in a row, without the first ``skip`` bytes."""
    body, at, size = strings
    out = [hashlib.sha256() for _ in range(len(ptr) - 1)]
    for lo in range(0, len(ids), _BLOCK):
        part = ids[lo : lo + _BLOCK]
        n = size[part]
        raw = memoryview(body[K.ranges(at[part], n)])
        edge = np.concatenate([[0], np.cumsum(n)])
        i, j = np.searchsorted(ptr, lo, "right") - 1, np.searchsorted(ptr, lo + len(part), "left")
        cut = edge[np.clip(ptr[i : j + 1] - lo, 0, len(part))].tolist()
        for d, a, b in zip(range(i, j), cut[:-1], cut[1:]):
            if b > a:
                out[d].update(raw[a + (skip if ptr[d] >= lo else 0) : b])
    return [h.hexdigest() for h in out]


#: The pieces that this worker process used last, by rank file: what a task has met, the next one need not encode.
_last: dict[tuple, Pieces] = {}


def piece_encoder(path: str) -> Pieces:
    """The encoder of a rank file, kept for the tasks that follow in the same process; ``tokens.LIMIT`` and ``tokens.ROOM`` bound it."""
    about = os.stat(path)
    key = (path, about.st_mtime_ns, about.st_size)
    if key not in _last:
        _last.clear()
        _last[key] = Pieces(load_ranks(path))
    return _last[key]


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every whole text."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def run(batches):
        enc = piece_encoder(path)
        for b, data, off in K.chunks(batches):
            s, ptr = pieces(data, off)
            if len(s):
                slot = enc.slots(data, s, np.append(s[1:], len(data)))
                n = enc.size[slot]
                ids = enc.pool[K.ranges(enc.start[slot], n)]
                count = np.concatenate([[0], np.cumsum(n)])[ptr]
            else:
                ids, count = np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
            sha, dec = sha256(ids, count, enc.named, 1), sha256(ids, count, enc.plain)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(count)), pa.array(sha, pa.string()), pa.array(dec, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
