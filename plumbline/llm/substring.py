"""Substring dedup of word windows by a log-structured fingerprint index.

An index is a folder of immutable runs. A run holds, for each bucket of hashes,
the sorted window fingerprints of one batch of documents (the anchor of a window,
see ``anchors``) with their documents. ``ingest`` merge-joins a new batch with the
stored runs, fetches the text of both sides where a fingerprint meets, verifies
window by window, writes the batch as a new run, and compacts runs of like size
into one, so there are about log(n) of them. Within a bucket the windows that met
go through a ``FingerprintLog`` in batches of their own, in order of document and start, so what
a run holds always starts earlier. Windows are compared word by word, words byte by byte.

An index keeps no texts: the caller hands in the earlier documents, and only those that
meet the batch are read further. Runs have an entry for each fingerprint and document,
copies included; the number of buckets is set with the first batch and kept.

Defined results: null and empty texts have no words; texts shorter than the window lose nothing, very long ones are
cut like others; null ids lose nothing; of equal texts the first stays whole; rows that share
an id count as one document, of which equal starts don't remove one another; an empty
table gives no rows; columns besides doc_id and text are not read. Documents of earlier batches come before all of a later one, whatever their ids.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline import tables

from . import anchors, kernels as K

U64 = K.U64
#: Windows of one batch within a bucket, more only where one document has more.
BATCH = 1 << 18


class FingerprintLog:
    """Sorted immutable runs of (window hash, place of the window); ``same(a, b)`` compares the windows at two places."""

    def __init__(self, same, factor: int = 4) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.same, self.factor = same, factor

    def probe(self, h: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether each of the sorted windows stands in any run."""
        found = np.zeros(len(h), bool)
        for rh, rp in self.runs:
            open_ = np.flatnonzero(~found)
            # both sides are sorted: a window's place in the run is the number of smaller hashes
            both = np.concatenate([rh, h[open_]])
            order = np.argsort(both, kind="stable")
            is_run = order < len(rh)
            at = np.empty(len(open_), np.int64)
            at[order[~is_run] - len(rh)] = np.cumsum(is_run)[~is_run] - 1  # the last entry that isn't larger
            while len(open_):
                inside = at >= 0
                open_, at = open_[inside], at[inside]
                equal = rh[at] == h[open_]
                open_, at = open_[equal], at[equal]
                sure = self.same(rp[at], place[open_])
                found[open_[sure]] = True
                open_, at = open_[~sure], at[~sure] - 1  # a hash met by chance: look at the entry before
        return found

    def append(self, h: np.ndarray, place: np.ndarray) -> None:
        """Adds a sorted run of windows that no run holds, then compacts runs of like size."""
        if not len(h):
            return
        self.runs.append((h, place))
        while len(self.runs) > 1 and len(self.runs[-2][0]) < self.factor * len(self.runs[-1][0]):
            (h1, p1), (h2, p2) = self.runs[-2:]
            h, place = np.concatenate([h1, h2]), np.concatenate([p1, p2])
            order = np.argsort(h, kind="stable")
            self.runs[-2:] = [(h[order], place[order])]

    def ingest(self, h: np.ndarray, place: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Whether each window of a batch, all later than the log, starts earlier in the log or in the batch itself."""
        order = np.lexsort((start, doc, h))
        seen = np.zeros(len(h), bool)
        left = order
        while len(left):  # once, and again for windows that share a hash by chance
            hs, ps = h[left], place[left]
            head = np.concatenate([[True], hs[1:] != hs[:-1]])
            first = np.flatnonzero(head)
            group = np.cumsum(head) - 1
            like = self.same(ps, ps[first][group])
            known = self.probe(hs[first], ps[first])
            lead = left[first][group]
            seen[left] = np.where(like, known[group] | (doc[left] != doc[lead]) | (start[left] != start[lead]), seen[left])
            self.append(hs[first][~known], ps[first][~known])
            left = left[~like]
        return seen


def judge(win: anchors.Windows):
    """The bucket step for ``anchors.snippets``: batches of windows against the bucket's log."""

    def run(fp, same, doc, lo, count, size, body):
        size = size.astype(np.int64)
        ends = np.cumsum(size)
        known, word, at = K.Vocabulary(), [], []  # the bucket's words by number, snippet by snippet
        for i in range(0, len(size), 1 << 14):
            part = slice(i, i + (1 << 14))
            n = size[part]
            data = body[ends[i] - n[0] : ends[part][-1]]
            s, e, ptr = K.word_spans(data, np.concatenate([[0], np.cumsum(n)]))
            word.append(known.numbers(data, s, e)[0].astype(np.int32))
            at.append(np.diff(ptr))
        word, at = np.concatenate(word), np.concatenate(at)
        at = np.cumsum(at) - at
        sums = K.prefix(K.mix(word.astype(U64) + U64(0x1234567)))

        def equal(a, b):
            out = a == b
            ask = np.flatnonzero(~out)
            for j in range(0, len(ask), 1 << 16):
                k = ask[j : j + (1 << 16)]
                w = np.arange(win.size)
                out[k] = (word[a[k][:, None] + w] == word[b[k][:, None] + w]).all(1)
            return out

        log = FingerprintLog(equal)
        order = np.lexsort((lo, doc))
        total = np.cumsum(count[order].astype(np.int64))
        out, i = [], 0
        while i < len(order):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + BATCH, "right")))
            while j < len(order) and doc[order[j]] == doc[order[j - 1]]:
                j += 1
            part = order[i:j]
            n = count[part].astype(np.int64)
            place = K.ranges(at[part], n)
            start = K.ranges(lo[part], n)
            of = np.repeat(doc[part], n)
            seen = log.ingest(K.spans(sums, place, place + win.size), place, of, start)
            out.append((of[seen], start[seen], start[seen] + win.size))
            i = j
        return tuple(np.concatenate(x) for x in zip(*out))

    return run


def windows(size: int = 20) -> anchors.Windows:
    return anchors.Windows(words=True, size=size, k=max(1, size - 12), inside=True)


def _meta(folder: str, write: dict | None = None) -> dict:
    from pyarrow import fs

    files, base = fs.FileSystem.from_uri(folder)
    path = f"{base}/index.json"
    if write is not None:
        files.create_dir(base, recursive=True)
        with files.open_output_stream(f"{path}.tmp") as f:
            f.write(json.dumps(write).encode())
        files.move(f"{path}.tmp", path)
        return write
    if not files.get_file_info(path).is_file:
        return {}
    with files.open_input_file(path) as f:
        return json.loads(f.read())


def _compact(spark: SparkSession, folder: str, meta: dict, factor: int) -> dict:
    """Merges the newest runs while the one before is less than ``factor`` times as large, each bucket by a task."""
    from pyarrow import fs

    files, base = fs.FileSystem.from_uri(folder)
    weigh = lambda r: sum(x.size for x in files.get_file_info(fs.FileSelector(f"{base}/{r}", allow_not_found=True)))
    runs, gone = list(meta["runs"]), []
    while len(runs) > 1 and weigh(runs[-2]) < factor * weigh(runs[-1]):
        a, b = runs[-2:]
        log = anchors.Log(folder, meta["buckets"], (a, b), f"run-{uuid.uuid4().hex[:12]}")

        def merge(batches, log=log, a=a, b=b):
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    (f1, d1), (f2, d2) = log.read(a, i), log.read(b, i)
                    f, d = np.concatenate([f1, f2]), np.concatenate([d1, d2])
                    order = np.argsort(f, kind="stable")
                    log.append(i, f[order], d[order])
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

        spark.range(0, meta["buckets"], 1, meta["buckets"]).mapInArrow(merge, "n long").count()
        runs[-2:] = [log.target]
        gone += [a, b]
    meta = _meta(folder, meta | {"runs": runs})
    for run in gone:
        files.delete_dir(f"{base}/{run}")
    return meta


def ingest(docs: DataFrame, folder: str, history: DataFrame | None = None, size: int = 20, factor: int = 4) -> DataFrame:
    """``docs`` with ``told``, the covered stretches of words, judged against the index in ``folder`` as well, of which the batch becomes part.

    ``history`` (doc_id, text) has the documents of the batches before.
    """
    spark, win = docs.sparkSession, windows(size)
    meta = _meta(folder) or {"buckets": tables.buckets(docs), "size": size, "runs": []}
    if meta["size"] != size:
        raise ValueError(f"the index is of windows of {meta['size']} words")
    if meta["runs"] and history is None:
        raise ValueError("the index has earlier batches: their documents are needed for verification")
    log = anchors.Log(folder, meta["buckets"], tuple(meta["runs"]), f"run-{uuid.uuid4().hex[:12]}")
    told = tables.materialise(anchors.meeting(anchors.own(docs), anchors.extractor(win), True, log), "op3-anchors")
    asked = anchors.with_blobs(anchors.own(docs), told.where("NOT old"), "fps", "inner").withColumn("old", F.lit(False))
    if meta["runs"]:
        asked = asked.unionByName(anchors.with_blobs(anchors.own(history), told.where("old"), "fps", "inner").withColumn("old", F.lit(True)))
    cover = tables.materialise(anchors.snippets(asked, win, judge(win), tables.buckets(docs)), "op3-covers")
    tables.drop_tables(spark, told)
    _compact(spark, folder, _meta(folder, meta | {"runs": [*meta["runs"], log.target]}), factor)
    return anchors.with_blobs(docs, cover, "cover", "left")


def dedup(docs: DataFrame, size: int = 20, folder: str | None = None, history: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (remaining words joined by a space) for every row.

    With ``folder`` the documents are a batch of the index there, see ``ingest``; otherwise nothing is stored.
    """

    def run(batches):
        for b, data, off in K.chunks(batches):
            s, e, ptr = K.word_spans(data, off)
            told = b.column(b.schema.get_field_index("told")).to_pylist()
            keep = np.ones(len(s), bool)
            for i, x in enumerate(told):
                for lo, hi in zip(*anchors.stretches(x)):
                    keep[ptr[i] + lo : ptr[i] + hi] = False
            n = np.diff(ptr)
            left = np.diff(np.concatenate([[0], np.cumsum(keep)])[ptr])
            length = (e - s)[keep]
            stop = np.cumsum(length + 1) - 1
            joined = np.full(int(stop[-1]) + 1 if len(stop) else 0, 32, np.uint8)
            joined[K.ranges(stop - length, length)] = data[K.ranges(s[keep], length)]
            joined = joined.tobytes()
            stop = np.concatenate([[-1], stop])
            edge = np.concatenate([[0], np.cumsum(left)])
            kept = [joined[int(stop[a]) + 1 : max(int(stop[z]), 0)] if z > a else b"" for a, z in zip(edge[:-1], edge[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(n - left, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array([k.decode() for k in kept], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    own, win = docs.select(F.col("doc_id").cast("long"), "text"), windows(size)
    found = ingest(own, folder, history, size) if folder else anchors.covered(own, win, judge(win), "op3")
    return found.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
