"""Finding repeated windows of symbols (bytes or words) without moving every window.

A window of ``size`` symbols holds size - k + 1 grams of k symbols; its *anchor*
is the gram of the least hash, the leftmost of equals. The choice depends on the
window's content alone, so equal windows have equal anchors at equal places, and
consecutive windows mostly share one: about one anchor for (size - k + 2) / 2
symbols. The steps are

1. ``repeated``: anchors are exchanged by hash, packed as binary blobs, one entry
   for each hash and load of a task (some MB), so a passage found everywhere sends
   a bucket at most one entry from each load; the answer is, for each document, the
   anchors that other documents (or other places) have too. Given a ``Log``, a
   bucket also merge-joins its batch with the stored runs and writes a new one;
2. ``snippets``: the stretch of text that the windows of such an anchor cover is
   sent to the anchor's bucket, one copy for each load; the copies of
   smaller rank within the load, equal byte by byte, answer for the others;
3. a method of the caller's compares the windows of one bucket and returns
   covered stretches, which are gathered by document.

Hashes only bring together what may be equal; equality is decided on contents.
Null ids and null texts take no part; rows that share an id count as one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from plumbline import tables

from . import kernels as K

U64 = K.U64
_LOW = (1 << 24) - 1
_HIGH = U64(((1 << 64) - 1) ^ _LOW)
_BLOCK = 1 << 22
#: Bytes of text looked at in one pass, so that its arrays of 64-bit values stay in caches.
_PASS = 1 << 18
#: Anchors, and bytes of snippets, that a task gathers before it sends a blob to each bucket.
_LOAD, _BODY = 1 << 20, 16 << 20
#: Taken off the ids of documents of earlier batches, so that they come before all others; ids must lie within half of it then.
_EARLIER = 1 << 62


@dataclass(frozen=True)
class Windows:
    """What a symbol is, how long windows are, and whether repeats inside one document count."""

    words: bool
    size: int
    k: int
    inside: bool

    def symbols(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(prefix sums of symbol values, symbol offsets, joined bytes, starts and ends of symbols in them)."""
        if not self.words:
            at = np.arange(len(data))
            return K.prefix(K.BYTES[data]), off, data, at, at + 1
        s, e, ptr = K.word_spans(data, off)
        values = K.words(data, s, e)
        # the words joined by one space each: the same words give the same bytes
        size = e - s
        ends = np.cumsum(size + 1) - 1
        joined = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, np.uint8)
        joined[K.ranges(ends - size, size)] = data[K.ranges(s, size)]
        return K.prefix(values), ptr, joined, ends - size, ends


def choose(sums: np.ndarray, ptr: np.ndarray, win: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window start, number of window starts, document index) of every anchor."""
    n_win = np.maximum(np.diff(ptr) - win.size + 1, 0)
    none = np.zeros(0, np.int64)
    if not n_win.sum():
        return none.astype(U64), none, none, none
    gram = K.grams(sums, win.k)
    w = win.size - win.k + 1
    total = int(ptr[-1]) - win.size + 1
    best = np.empty(total, np.int64)
    for lo in range(0, total, _BLOCK):
        hi = min(lo + _BLOCK, total)
        g = gram[lo : hi + w - 1]
        best[lo:hi] = (K.sliding_min(g & _HIGH | np.arange(len(g), dtype=U64), w) & U64(_LOW)).astype(np.int64) + lo
    starts = K.ranges(ptr[:-1], n_win)
    p = best[starts]
    head = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    count = np.diff(np.append(head, len(p)))
    return gram[p[head]], starts[head], count, np.searchsorted(ptr, starts[head], "right") - 1


#: Bits of an anchor hash that are exchanged: chance equals only cost work.
_FP = U64((1 << 48) - 1)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one zstandard-compressed blob."""
    import zstandard

    return zstandard.compress(np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays), 1)


def unpack(blob: bytes, *types) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.decompress(blob)
    sizes = np.frombuffer(raw, np.int64, int(np.frombuffer(raw, np.int64, 1)[0]), 8)
    at = 8 + sizes.nbytes + np.concatenate([[0], np.cumsum(sizes)])
    return [np.frombuffer(raw, t, int(n) // np.dtype(t).itemsize, int(a)) for t, a, n in zip(types, at, sizes)]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    """(bucket, kind, blob) rows: kind 0 goes to be compared, kind 1 is an answer on its way to a group of documents."""
    cols = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), K.blobs(cols[2])], ["bucket", "kind", "blob"])


_PACKED = "bucket int, kind int, blob binary"


def _answers(doc: np.ndarray, b: int, *values: np.ndarray) -> list[tuple]:
    """Rows of kind 1 for (document, values), one for each group of documents."""
    group = (doc % b).astype(np.int32)
    order = np.lexsort((doc, group))
    at = np.searchsorted(group[order], np.arange(b + 1))
    return [(i, 1, pack(doc[order[at[i] : at[i + 1]]], *(v[order[at[i] : at[i + 1]]] for v in values))) for i in range(b) if at[i + 1] > at[i]]


def _routed(rows: DataFrame, b: int, meet: Callable, gather: Callable, schema: str, old: bool = False) -> DataFrame:
    """Rows to their buckets, the answers to their groups of documents, one row for each document out; with ``old`` those of kind 2 apart."""

    def first(batches):
        held, bucket = [], 0
        for batch in batches:
            kind = batch.column(1).to_numpy()
            blobs = batch.column(2)
            at = np.flatnonzero(kind > 0)
            if len(at):
                yield batch.take(pa.array(at))
            at = np.flatnonzero(kind == 0)
            if len(at):
                bucket = batch.column(0)[int(at[0])].as_py()
            held += [blobs[int(i)].as_py() for i in at]
        if held:
            yield _rows(meet(held, bucket))

    def second(batches):
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for kind, x in zip(batch.column(1).to_pylist(), batch.column(2)):
                held.setdefault(kind, []).append(x.as_py())
        for kind in sorted(held):
            for out in gather(held[kind]):
                yield out.append_column("old", pa.array(np.full(out.num_rows, kind == 2))) if old else out

    return rows.repartitionById(b, F.col("bucket")).mapInArrow(first, _PACKED).repartitionById(b, F.col("bucket")).mapInArrow(second, schema + ", old boolean" * old)


def _by_doc(doc_ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    order = np.argsort(doc_ids, kind="stable")
    ids, at = np.unique(doc_ids[order], return_index=True)
    return ids, np.split(values[order], at[1:])


def repeated(docs: DataFrame, win: Windows) -> DataFrame:
    """(doc_id, fps): anchors of a document that occur elsewhere too, as blobs of hashes; one row for each document."""
    return meeting(own(docs), extractor(win), win.inside)


def own(docs: DataFrame) -> DataFrame:
    """Ids and texts of the rows that take part."""
    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")


def extractor(win: Windows) -> Callable:
    """The anchors of texts, for ``meeting``."""

    def extract(batches):
        for batch, data, off in K.chunks(batches, budget=_PASS):
            sums, ptr, *_ = win.symbols(data, off)
            fp, _, _, doc = choose(sums, ptr, win)
            yield fp, K.ids_column(batch)[doc]

    return extract


def _loads(parts: Iterator, most: int, weigh: Callable):
    """Tuples of arrays put together until they weigh enough."""
    held, weight = [], 0
    for part in parts:
        held.append(part)
        weight += weigh(part)
        if weight >= most:
            yield [np.concatenate(x) for x in zip(*held)]
            held, weight = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _twice(f: np.ndarray) -> np.ndarray:
    """Which of sorted values have an equal neighbour."""
    same = f[1:] == f[:-1]
    hot = np.zeros(len(f), bool)
    hot[1:] |= same
    hot[:-1] |= same
    return hot


def meeting(rows: DataFrame, extract: Callable, inside: bool, log: Log | None = None) -> DataFrame:
    """(doc_id, fps): for each document, those of its hashes that other documents have too (with ``inside``: or that it has twice).

    ``extract(batches)`` yields (hashes, document ids) for some rows at a time;
    the hashes in the answer are cut to 48 bits. One row for each document. With ``log``
    the hashes of its runs count as well, a new run is written, and there is a
    column ``old``: true in the rows of earlier documents.
    """
    b = log.buckets if log else tables.buckets(rows)

    def send(batches: Iterator[pa.RecordBatch]):
        for fp, doc in _loads(extract(batches), _LOAD, lambda x: len(x[0])):
            if not len(fp):
                continue
            fp = fp & _FP
            order = np.lexsort((doc, fp))
            fp, doc = fp[order], doc[order]
            if not inside:
                new = np.concatenate([[True], (fp[1:] != fp[:-1]) | (doc[1:] != doc[:-1])])
                fp, doc = fp[new], doc[new]
            head = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
            size = np.diff(np.append(head, len(fp)))
            many = np.repeat(size > 1, size)
            rows = _answers(doc[many], b, fp[many]) if many.any() else []
            if log:  # which documents have a hash is for the log to keep
                many = many & ~np.concatenate([[True], doc[1:] != doc[:-1]]) & np.concatenate([[False], fp[1:] == fp[:-1]])
                fp, doc, told = fp[~many], doc[~many], np.repeat(size > 1, size)[~many]
            else:
                fp, doc, told = fp[head], doc[head], size > 1
            bucket = ((fp >> U64(8)) % U64(b)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            at = np.searchsorted(bucket[order], np.arange(b + 1))
            for i in range(b):
                mine = order[at[i] : at[i + 1]]
                if len(mine):
                    table, idx = np.unique(doc[mine], return_inverse=True)
                    rows.append((i, 0, pack(_six(fp[mine]), table, idx.astype(np.uint32), np.packbits(told[mine]))))
            yield _rows(rows)

    def meet(held: list[bytes], bucket: int) -> list[tuple]:
        fps, docs_, many = [], [], []
        for blob in held:
            six, table, idx, bits = unpack(blob, np.uint8, np.int64, np.uint32, np.uint8)
            fps.append(_wide(six))
            docs_.append(table[idx])
            many.append(np.unpackbits(bits, count=len(idx)).astype(bool))
        held.clear()
        f, d, m = np.concatenate(fps), np.concatenate(docs_), np.concatenate(many)
        del fps, docs_, many
        order = np.argsort(f, kind="stable")
        f, d, m = f[order], d[order], m[order]
        hot = _twice(f) & ~m  # those have been told their documents already
        if not log:
            return _answers(d[hot], b, f[hot])
        met, old_f, old_d = log.probe(bucket, f)
        log.append(bucket, f, d)
        return _answers(d[hot | met], b, f[hot | met]) + [(i, 2, blob) for i, _, blob in _answers(old_d, b, old_f)]

    def gather(held: list[bytes]):
        parts = [unpack(x, np.int64, U64) for x in held]
        doc, fp = (np.concatenate([p[i] for p in parts]) for i in range(2))
        ids, lists = _by_doc(doc, fp)
        for i in range(0, len(ids), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 4096]), K.blobs([np.unique(x) for x in lists[i : i + 4096]])], ["doc_id", "fps"])

    return _routed(rows.mapInArrow(send, _PACKED), b, meet, gather, "doc_id long, fps binary", old=log is not None)


def _six(fp: np.ndarray) -> np.ndarray:
    """48-bit hashes as six bytes each."""
    return np.ascontiguousarray(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8)[:, :6])


def _wide(six: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(six) // 6, 8), np.uint8)
    wide[:, :6] = six.reshape(-1, 6)
    return wide.view(U64).ravel()


@dataclass(frozen=True)
class Log:
    """Immutable runs of hashes in a shared folder, each sorted, one file for each run and bucket.

    Tasks write to a name of their own attempt and rename it, so a repeated task leaves one file.
    """

    folder: str
    buckets: int
    runs: tuple[str, ...]  #: to be merge-joined with
    target: str  #: the run that this batch becomes

    def _path(self, run: str, bucket: int):
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(self.folder)
        return files, f"{base}/{run}/{bucket:06d}.run"

    def read(self, run: str, bucket: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, documents) of a bucket of a run, sorted by hash."""
        files, path = self._path(run, bucket)
        if not files.get_file_info(path).is_file:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        with files.open_input_file(path) as f:
            six, table, idx = unpack(f.read(), np.uint8, np.int64, np.uint32)
        return _wide(six), table[idx]

    def write(self, run: str, bucket: int, fp: np.ndarray, doc: np.ndarray) -> None:
        files, path = self._path(run, bucket)
        files.create_dir(path.rsplit("/", 1)[0], recursive=True)
        table, idx = np.unique(doc, return_inverse=True)
        mine = f"{path}.{TaskContext.get().taskAttemptId()}.tmp"
        with files.open_output_stream(mine) as f:
            f.write(pack(_six(fp), table, idx.astype(np.uint32)))
        files.move(mine, path)

    def append(self, bucket: int, fp: np.ndarray, doc: np.ndarray) -> None:
        self.write(self.target, bucket, fp, doc)

    def probe(self, bucket: int, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the sorted hashes stand in a run, and (hash, document) of those entries of the runs; both sides are sorted and merged."""
        met, old_f, old_d = np.zeros(len(f), bool), [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for run in self.runs:
            rf, rd = self.read(run, bucket)
            both = np.concatenate([f, rf])
            order = np.argsort(both, kind="stable")  # of two sorted pieces: one merge
            key = both[order]
            head = np.concatenate([[True], key[1:] != key[:-1]])
            group = np.cumsum(head) - 1
            new = order < len(f)
            has_new, has_old = np.bincount(group, new) > 0, np.bincount(group, ~new) > 0
            hit = (has_new & has_old)[group]
            met[order[hit & new]] = True
            at = np.sort(order[hit & ~new] - len(f))
            old_f.append(rf[at])
            old_d.append(rd[at])
        return met, np.concatenate(old_f), np.concatenate(old_d)


def with_blobs(docs: DataFrame, told: DataFrame, column: str, how: str) -> DataFrame:
    """docs joined with each document's blob, as column ``told``."""
    # the same plan at every size: a small answer would be broadcast, a large one not
    told = told.select(F.col("doc_id").alias("__id"), F.col(column).alias("told")).hint("merge")
    return docs.join(told, F.col("doc_id") == F.col("__id"), how).drop("__id")


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open stretches, sorted."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    head = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
    return lo[head], hi[np.append(head[1:], len(hi)) - 1]


def covers(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """(document ids, blobs of merged stretches as int64 pairs)."""
    order = np.argsort(doc, kind="stable")
    ids, at = np.unique(doc[order], return_index=True)
    out = []
    for part in np.split(order, at[1:]):
        a, b = merged(lo[part], hi[part])
        out.append(np.stack([a, b], 1).astype(np.int64))
    return ids, out


def unlike(body: np.ndarray, start: np.ndarray, size: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which stretches of ``body`` differ from the stretch of number ``other``, byte by byte."""
    out = size != size[other]
    at = np.flatnonzero(~out & (other != np.arange(len(other))))
    for part in np.split(at, np.flatnonzero(np.diff(np.cumsum(size[at]) // _BODY)) + 1) if len(at) else ():
        n = size[part]
        differ = body[K.ranges(start[part], n)] != body[K.ranges(start[other[part]], n)]
        if differ.any():
            out[part[np.unique(np.repeat(np.arange(len(part)), n)[differ])]] = True
    return out


def snippets(docs: DataFrame, win: Windows, judge: Callable, b: int) -> DataFrame:
    """(doc_id, cover): stretches of symbols that windows found before cover, merged, as a blob of pairs; one row for each document.

    ``docs`` has doc_id, text, told (hashes) and, if there are documents of earlier batches, ``old``; those are answered nothing.
    ``judge(fp, same, doc, lo, count, size, body)`` gets a bucket's snippets (for
    each one: anchor hash, content hash, document, first window, windows, bytes)
    and returns (document, from symbol, to symbol) arrays; documents of earlier batches have numbers below all others.
    """
    types = (np.uint32, U64, np.int64, np.uint32, np.int64, np.int32, np.int32, np.uint8)

    def cut(batches):
        for batch, data, off in K.chunks(batches, budget=_PASS):
            want = [np.frombuffer(x, U64) for x in batch.column(batch.schema.get_field_index("told")).to_pylist() if x]
            sums, ptr, body, s, e = win.symbols(data, off)
            fp, first, count, doc = choose(sums, ptr, win)
            if not want or not len(fp):
                continue
            fp = fp & _FP
            want = np.unique(np.concatenate(want))
            at = np.searchsorted(want, fp)
            at[at == len(want)] = 0
            hot = want[at] == fp
            fp, first, count, doc = fp[hot], first[hot], count[hot], doc[hot]
            if not len(fp):
                continue
            lo, until = first - ptr[doc], first + count - 1 + win.size
            a, z = s[first], e[until - 1]
            ids = K.ids_column(batch)
            at = batch.schema.get_field_index("old")
            if at >= 0:
                ids = np.where(batch.column(at).to_numpy(zero_copy_only=False), ids - _EARLIER, ids)
            yield fp, K.spans(sums, first, until), ids[doc], lo, count, z - a, body[K.ranges(a, z - a)]

    def send(batches: Iterator[pa.RecordBatch]):
        for fp, same, ids, lo, count, size, body in _loads(cut(batches), _BODY, lambda x: len(x[-1])):
            start = np.cumsum(size) - size
            order = np.lexsort((lo, ids, same))
            head = np.concatenate([[True], (same[order][1:] != same[order][:-1])])
            group = np.cumsum(head) - 1
            keep = ids[order] == ids[order][head][group]
            if win.inside:
                keep &= lo[order] == lo[order][head][group]
            other = np.empty(len(order), np.int64)
            other[order] = order[head][group]
            keep |= unlike(body, start, size, other)[order]
            later = order[~keep]
            rows = []
            later = later[ids[later] > -(_EARLIER >> 1)]
            if len(later):
                d, x, y = _flat(ids[later], lo[later], lo[later] + count[later] - 1 + win.size)
                rows += _answers(d, b, x, y)
            order = order[keep]
            bucket = ((fp[order] >> U64(8)) % U64(b)).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            at = np.searchsorted(bucket[by], np.arange(b + 1))
            for i in range(b):
                mine = np.sort(order[by[at[i] : at[i + 1]]])
                if len(mine):
                    table, idx = np.unique(ids[mine], return_inverse=True)
                    rows.append((i, 0, pack((fp[mine] >> U64(16)).astype(np.uint32), same[mine], table, idx.astype(np.uint32), lo[mine].astype(np.int64), count[mine].astype(np.int32), size[mine].astype(np.int32), body[K.ranges(start[mine], size[mine])])))
            yield _rows(rows)

    def meet(held: list[bytes], bucket: int) -> list[tuple]:
        kept: list[list[np.ndarray]] = [[] for _ in range(7)]
        for blob in held:
            fp, same, table, idx, lo, count, size, body = unpack(blob, *types)
            for k, v in zip(kept, (fp, same, table[idx], lo, count, size, body)):
                k.append(v)
        held.clear()
        whole = []
        for k in kept:
            whole.append(np.concatenate(k))
            k.clear()
        doc, lo, hi = _flat(*judge(*whole))
        new = doc > -(_EARLIER >> 1)
        return _answers(doc[new], b, lo[new], hi[new])

    def gather(held: list[bytes]):
        parts = [unpack(x, np.int64, np.int64, np.int64) for x in held]
        ids, pairs = covers(*(np.concatenate([p[i] for p in parts]) for i in range(3)))
        for i in range(0, len(ids), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 4096]), K.blobs(pairs[i : i + 4096])], ["doc_id", "cover"])

    return _routed(docs.mapInArrow(send, _PACKED), b, meet, gather, "doc_id long, cover binary")


def _flat(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches merged within each document."""
    ids, pairs = covers(doc, lo, hi)
    both = np.concatenate([np.zeros((0, 2), np.int64), *pairs])
    return np.repeat(ids, [len(p) for p in pairs]), both[:, 0].copy(), both[:, 1].copy()


def covered(docs: DataFrame, win: Windows, judge: Callable, name: str) -> DataFrame:
    """docs (all rows) with ``told``: the covered stretches of each document as a blob, null where there is none."""
    spark = docs.sparkSession
    told = tables.materialise(repeated(docs, win), f"{name}-anchors")
    cover = tables.materialise(snippets(with_blobs(own(docs), told, "fps", "inner"), win, judge, tables.buckets(docs)), f"{name}-covers")
    tables.drop_tables(spark, told)
    return with_blobs(docs, cover, "cover", "left")


def stretches(told) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) of a row's merged stretches."""
    pairs = np.frombuffer(told or b"", np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]
