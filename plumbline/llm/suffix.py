"""Suffix-array dedup of bytes: shard Burrows-Wheeler transforms merged by interleave refinement.

Text that can hold a repeated window (found through ``anchors``) meets in
buckets. A bucket cuts its distinct stretches into shards and sorts each shard's
suffixes once, by their first ``size`` symbols, for its BWT. The merge never
compares suffixes again. It keeps an interleave: for each place of the merged
order the shard that the row comes from, the rows of a shard being in its own
order. The first is right by the symbols that one key holds (7). From an interleave right by h - 1 symbols, one pass along the BWT
columns, stably sorted by the symbols read, gives the one right by h. A boundary
that first shows in pass h means a common prefix of h - 1 symbols with the row in front.
Rows alone between two boundaries are settled and leave the merge. After ``size``
passes the stretches of rows without a boundary between them, of common prefixes of ``size`` or more, are the repeated intervals.

Defined results: null and empty texts are empty; a text shorter than the window loses nothing, very long ones
are cut like others; null ids and ids without an equal window
lose nothing; rows that share an id never remove from one another; a window is removed where
it also starts in a document of smaller id, so of equal texts the smallest id stays whole; an empty table gives no rows; columns
besides doc_id and text are not read by ``dedup`` and pass through ``find``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import anchors, kernels as K

#: Bytes of one shard, and of what a bucket merges at once: some MB of arrays, which caches hold.
SHARD, PART = 1 << 16, 1 << 18
_STEP = 7


def _keys(sym: np.ndarray) -> np.ndarray:
    """The first ``_STEP`` symbols of each suffix as one number; behind a string's end there is nothing."""
    n = len(sym)
    padded = np.concatenate([sym, np.zeros(_STEP, np.uint16)])
    key, alive = np.zeros(n, np.int64), np.ones(n, np.uint16)
    for j in range(_STEP):
        x = padded[j : j + n] * alive
        key <<= 9
        key |= x
        np.not_equal(x, 0, out=alive, casting="unsafe")
    return key


class Shard:
    """BWT of a collection of byte strings; every string ends in a symbol below all bytes."""

    def __init__(self, body: np.ndarray, size: np.ndarray, first: int, depth: int) -> None:
        ends = np.cumsum(size + 1) - 1
        sym = np.zeros(int(ends[-1]) + 1, np.uint16)
        inside = K.ranges(ends - size, size)
        sym[inside] = body.astype(np.uint16) + np.uint16(1)
        self.of = np.repeat(np.arange(first, first + len(size), dtype=np.int32), size + 1)
        self.at = (np.arange(len(sym)) - np.repeat(ends - size, size + 1)).astype(np.int32)
        sa = self.sort(sym, depth)
        self.key = _keys(sym)[sa]
        rank = np.empty(len(sa), np.int32)
        rank[sa] = np.arange(len(sa))
        before = sa - 1
        self.bwt = np.where(self.at[sa] > 0, sym[before], 0).astype(np.uint16)
        self.lf = np.where(self.at[sa] > 0, rank[before], -1)
        self.sa = sa.astype(np.int32)

    @staticmethod
    def sort(sym: np.ndarray, depth: int) -> np.ndarray:
        """Suffixes in the order of their first ``depth`` symbols or more, a string's end below all; ties are in any order."""
        n, key = len(sym), _keys(sym)
        sa = np.argsort(key)
        k = key[sa]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        # suffixes that tie and go on, sorted again by their next symbols; a string that ended stays in its place
        tied = np.flatnonzero(~(new & np.append(new[1:], True)) & (k & 511 > 0))
        done = _STEP
        group = np.cumsum(new) - 1
        while done < depth and len(tied):
            nxt = key[np.minimum(sa[tied] + done, n - 1)]
            order = np.lexsort((nxt, group[tied]))
            sa[tied] = sa[tied][order]
            nxt, g = nxt[order], group[tied]
            edge = np.concatenate([[True], (nxt[1:] != nxt[:-1]) | (g[1:] != g[:-1])])
            group[tied] = tied[np.maximum.accumulate(np.where(edge, np.arange(len(tied)), 0))] + n  # a name of its own for each new group
            tied = tied[~(edge & np.append(edge[1:], True)) & (nxt & 511 > 0)]
            done += _STEP
        return sa


def merge(shards: list[Shard], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, common prefixes): rows of the merged order, numbered shard by shard, that share their first ``size`` symbols with a neighbour.

    A row's common prefix is that with the row in front, -1 where it is ``size`` or more.
    """
    base = np.cumsum([0, *(len(s.bwt) for s in shards)])
    bwt = np.concatenate([s.bwt for s in shards])
    if bwt.max() < 256:
        bwt = bwt.astype(np.uint8)  # sorted in one pass instead of two
    lf = np.concatenate([np.where(s.lf >= 0, s.lf + np.int32(b), np.int32(-1)) for s, b in zip(shards, base)])
    lcp = np.full(base[-1], -1, np.int16)
    # the first interleave, right by ``start`` symbols: the shards' rows merged by the symbols that one key holds
    start = min(_STEP, size - 1)
    key = np.concatenate([s.key for s in shards]) >> 9 * (_STEP - start)
    order = np.argsort(key, kind="stable")
    key = key[order]
    interleave = np.repeat(np.arange(len(shards), dtype=np.uint8 if len(shards) <= 256 else np.uint16), np.diff(base))[order]
    rows = np.empty(base[-1], np.int32)
    rows[np.argsort(interleave, kind="stable")] = np.arange(base[-1], dtype=np.int32)
    edge = np.concatenate([[True], key[1:] != key[:-1], [True]])
    at = np.flatnonzero(edge[1:-1]) + 1
    apart = key[at] ^ key[at - 1]
    lcp[rows[0]] = 0
    lcp[rows[at]] = sum((apart >> 9 * j == 0).astype(np.int16) for j in range(start))
    more = ~(edge[:-1] & edge[1:])
    if start:
        more &= key & 511 > 0
    block = np.cumsum(edge[:-1], dtype=np.int32)[more]
    rows, interleave = rows[more], interleave[more]
    stepped = np.zeros(base[-1], bool)
    for h in range(start + 1, size + 1):
        sym = bwt[rows]
        # strings that begin here come first, and go no further
        order = np.argsort(sym, kind="stable")[len(sym) - np.count_nonzero(sym) :]
        if not len(order):
            return np.zeros(0, np.int32), np.zeros(0, np.int16)
        to = lf[rows]
        stepped[to[order]] = True
        sym, block, interleave = sym[order], block[order], interleave[order]
        # the k-th place of a shard is the k-th of its rows
        rows = np.empty(len(sym), np.int32)
        rows[np.argsort(interleave, kind="stable")] = there = np.flatnonzero(stepped)
        stepped[there] = False
        edge = np.empty(len(sym) + 1, bool)
        edge[0] = edge[-1] = True
        np.not_equal(sym[1:], sym[:-1], out=edge[1:-1])
        edge[1:-1] |= block[1:] != block[:-1]
        first = rows[edge[:-1]]
        first = first[lcp[first] < 0]
        lcp[first] = h - 1
        block = np.cumsum(edge[:-1], dtype=np.int32)
        more = ~(edge[:-1] & edge[1:])
        if not more.all():
            rows, block, interleave = rows[more], block[more], interleave[more]
    return rows, lcp[rows]


def repeated_windows(shards: list[Shard], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(interval, string, offset) of every window of ``size`` symbols that stands more than once in the shards' strings."""
    rows, lcp = merge(shards, size)
    of = np.concatenate([s.of[s.sa] for s in shards])[rows]
    at = np.concatenate([s.at[s.sa] for s in shards])[rows]
    return np.cumsum(lcp >= 0) - 1, of, at


def judge(win: anchors.Windows):
    """The bucket step for ``anchors.snippets``: covered stretches by merged shard BWTs.

    Equal windows have equal anchors, so a bucket is worked off in parts by anchor hash, each of about ``PART`` bytes.
    """

    def run(fp, same, doc, lo, count, size, body):
        starts = np.cumsum(size, dtype=np.int64) - size
        parts = -(-len(body) // PART)
        part = (fp % np.uint32(max(parts, 1))).astype(np.int32)
        order = np.argsort(part, kind="stable")
        at = np.searchsorted(part[order], np.arange(parts + 1))
        out = []
        for i in range(parts):
            mine = order[at[i] : at[i + 1]]
            if len(mine):
                out += _part(win, same[mine], doc[mine], lo[mine], count[mine], size[mine].astype(np.int64), starts[mine], body)
        return tuple(np.concatenate(x) for x in zip(*out))

    return run


def _part(win, same, doc, lo, count, size, starts, body) -> list:
    order = np.lexsort((doc, same))
    head = np.concatenate([[True], same[order][1:] != same[order][:-1]])
    # equal hashes are compared byte by byte; a stretch that differs is a text of its own
    other = np.empty(len(same), np.int64)
    other[order] = order[head][np.cumsum(head) - 1]
    odd = anchors.unlike(body, starts, size, other)[order]
    if odd.any():
        order = np.concatenate([order[~odd], order[odd]])
        head = np.concatenate([head[~odd], np.ones(int(odd.sum()), bool)])
    text_of = np.empty(len(same), np.int64)
    text_of[order] = np.cumsum(head) - 1
    pick = order[head]  # one copy of each distinct stretch, from its smallest document
    least = doc[pick]
    copies = doc > least[text_of]
    out = [(doc[copies], lo[copies], lo[copies] + count[copies] - 1 + win.size)]
    held = np.cumsum(size[pick] + 1)
    shards, i = [], 0
    while i < len(pick):
        j = max(i + 1, int(np.searchsorted(held, (held[i - 1] if i else 0) + SHARD, "right")))
        chosen = pick[i:j]
        shards.append(Shard(body[K.ranges(starts[chosen], size[chosen])], size[chosen], i, win.size))
        i = j
    block, of, at = repeated_windows(shards, win.size)
    if len(block):
        first = np.full(int(block.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, block, least[of])
        late = first[block] < least[of]
        of, at = of[late].astype(np.int64), at[late].astype(np.int64)
        # each stretch's windows, for every row of its smallest document
        rows = np.flatnonzero(~copies)
        rows = rows[np.argsort(text_of[rows], kind="stable")]
        n = np.bincount(text_of[rows], minlength=len(pick))
        skip = np.cumsum(n) - n
        r = rows[K.ranges(skip[of], n[of])]
        a = np.repeat(at, n[of])
        got, pairs = anchors.covers(doc[r], lo[r] + a, lo[r] + a + win.size)
        flat = np.concatenate([np.zeros((0, 2), np.int64), *pairs])
        out.append((np.repeat(got, [len(p) for p in pairs]), flat[:, 0], flat[:, 1]))
    return out


def windows(size: int = 50) -> anchors.Windows:
    return anchors.Windows(words=False, size=size, k=max(1, size - 30), inside=False)


def find(docs: DataFrame, size: int = 50) -> DataFrame:
    """docs with ``told``, the removed byte stretches as blobs."""
    win = windows(size)
    return anchors.covered(docs, win, judge(win), "op5")


def kept_bytes(text: bytes, told) -> tuple[bytes, int, int]:
    """(remaining bytes, bytes removed, maximal removed runs)."""
    lo, hi = anchors.stretches(told)
    if not len(lo):
        return text, 0, 0
    # stretches that touch are one run
    gone = int((hi - lo).sum())
    parts, at = [], 0
    for a, b in zip(lo.tolist(), hi.tolist()):
        parts.append(text[at:a])
        at = b
    parts.append(text[at:])
    return b"".join(parts), gone, len(lo)


def dedup(docs: DataFrame, size: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes) for every row."""

    def run(batches):
        for batch in batches:
            text = K.text_column(batch, "text")
            told = batch.column(batch.schema.get_field_index("told")).to_pylist()
            n, gone, spans, sha, kept = [], [], [], [], []
            for t, x in zip(text, told):
                raw = t.as_buffer().to_pybytes()
                rest, g, s = kept_bytes(raw, x)
                n.append(len(raw))
                gone.append(g)
                spans.append(s)
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return find(docs.select(F.col("doc_id").cast("long"), "text"), size).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def cut_text(found: DataFrame) -> DataFrame:
    """``find``'s rows with ``__cut``: what is left of the text, without the bytes of characters that a cut went through."""

    def run(texts):
        for text, told in texts:
            yield pa.array([kept_bytes(t.as_buffer().to_pybytes() if t.is_valid else b"", x)[0].decode("utf-8", "ignore") for t, x in zip(text.cast(pa.large_string()), told.to_pylist())], pa.string())

    # not deterministic for the optimiser, so that a filter on the result doesn't run it twice
    cut = F.arrow_udf(run, "string", F.ArrowUDFType.SCALAR_ITER).asNondeterministic()
    return found.withColumn("__cut", cut(F.col("text"), F.col("told")))
