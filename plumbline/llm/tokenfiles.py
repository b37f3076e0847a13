"""Token-id files of independent zstandard frames with a trailing seek table.

A file holds, in ascending order of document,

* data frames: the little-endian unsigned 32-bit ids of consecutive documents,
  one zstandard frame with its own content checksum for about ``frame`` ids;
* a skippable frame with the compressed index: (document, ids, frame) of each document;
* the seek table, a skippable frame in the public zstandard seekable format:
  compressed size, size and checksum of each data frame, then the number of frames, flags and magic.

A reader takes the table and index from the file's end and decompresses only the
frames of the documents asked for. Tasks write to a name of their own attempt and rename it,
so a repeated task leaves one file.

Defined results: null text is empty, an empty document has the end id only; null ids come first and
rows that share an id keep an order by text hash.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from plumbline import tables

from . import kernels as K, tokens

_SKIP, _SEEK, _SEEK_END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_INDEX = np.dtype([("doc", "<i8"), ("n", "<u4"), ("frame", "<u4")])
_ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])


@dataclass(frozen=True)
class FileConfig:
    end_id: int = 2
    frame: int = 1 << 16  #: ids from which a frame is closed
    level: int = 3


class Writer:
    """Builds one file in memory, frame by frame."""

    def __init__(self, out, cfg: FileConfig) -> None:
        import zstandard
        from xxhash import xxh64_intdigest

        self.out, self.cfg, self.hash = out, cfg, xxh64_intdigest
        self.pack = zstandard.ZstdCompressor(level=cfg.level, write_checksum=True, write_content_size=True)
        self.index: list[np.ndarray] = []
        self.entries: list[tuple[int, int, int]] = []
        self.total = 0

    def frame(self, docs: np.ndarray, n: np.ndarray, ids: np.ndarray) -> None:
        raw = ids.astype("<u4").tobytes()
        packed = self.pack.compress(raw)
        self.out.write(packed)
        rows = np.empty(len(docs), _INDEX)
        rows["doc"], rows["n"], rows["frame"] = docs, n, len(self.entries)
        self.index.append(rows)
        self.entries.append((len(packed), len(raw), self.hash(raw) & 0xFFFFFFFF))
        self.total += len(ids)

    def close(self) -> None:
        body = self.pack.compress(np.concatenate([np.zeros(0, _INDEX), *self.index]).tobytes())
        self.out.write(struct.pack("<II", _SKIP, len(body)) + body)
        table = np.array(self.entries, _ENTRY).tobytes() + struct.pack("<IBI", len(self.entries), 0x80, _SEEK_END)
        self.out.write(struct.pack("<II", _SEEK, len(table)) + table)


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, src) -> None:
        import zstandard
        from xxhash import xxh64_intdigest

        self.src, self.hash, self.unpack = src, xxh64_intdigest, zstandard.ZstdDecompressor()
        size = src.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != _SEEK_END or not flags & 0x80:
            raise ValueError("not a file with a seek table and checksums")
        begin = size - 9 - n * _ENTRY.itemsize
        self.entries = np.frombuffer(self._at(begin, n * _ENTRY.itemsize), _ENTRY)
        self.starts = np.concatenate([[0], np.cumsum(self.entries["packed"].astype(np.int64))])
        head = int(self.starts[-1])
        magic, length = struct.unpack("<II", self._at(head, 8))
        if magic != _SKIP:
            raise ValueError("the index is missing")
        self.index = np.frombuffer(self.unpack.decompress(self._at(head + 8, length)), _INDEX)

    def _at(self, start: int, n: int) -> bytes:
        self.src.seek(start)
        return self.src.read(n)

    def frame(self, i: int) -> np.ndarray:
        e = self.entries[i]
        raw = self.unpack.decompress(self._at(int(self.starts[i]), int(e["packed"])), max_output_size=int(e["size"]))
        if len(raw) != e["size"] or self.hash(raw) & 0xFFFFFFFF != e["check"]:
            raise ValueError(f"frame {i} is damaged")
        return np.frombuffer(raw, "<u4")

    def documents(self, wanted=None):
        """(place in the file, document, ids), only of documents in ``wanted`` if it is given."""
        n = self.index["n"].astype(np.int64)
        mine = np.arange(len(n)) if wanted is None else np.flatnonzero(np.isin(self.index["doc"], np.asarray(wanted)))
        before = np.concatenate([[0], np.cumsum(n)])
        open_, ids, base = -1, None, 0
        for i in mine.tolist():
            f = int(self.index["frame"][i])
            if f != open_:
                open_, ids, base = f, self.frame(f), before[int(np.searchsorted(self.index["frame"], f))]
            yield i, int(self.index["doc"][i]), ids[before[i] - base : before[i + 1] - base]


def _filesystem(url: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(url)


def write(docs: DataFrame, folder: str, path: str | None = None, cfg: FileConfig = FileConfig()) -> DataFrame:
    """Writes token files of ``docs`` (doc_id, text) into ``folder``; returns their manifest (part, file, n_docs, n_ids), itself a table."""
    path = path or tokens.default_path()
    spark = docs.sparkSession

    def run(batches):
        enc, files, target = None, None, ""
        part = TaskContext.get().partitionId()
        n_docs, held = 0, [[], [], []]
        out = writer = tmp = None

        def flush():
            if held[0]:
                writer.frame(*(np.concatenate(x) for x in held))
                for x in held:
                    x.clear()

        for b, data, off in K.chunks(batches):
            if writer is None:
                enc = tokens.word_encoder(path)
                files, base = _filesystem(folder)
                files.create_dir(base, recursive=True)
                target = f"{base}/part-{part:06d}.tok"
                tmp = f"{target}.{TaskContext.get().taskAttemptId()}.tmp"
                out = files.open_output_stream(tmp)
                writer = Writer(out, cfg)
            ids, ptr = tokens.with_end(*enc.ids(data, off), cfg.end_id)
            doc = K.ids_column(b)
            n_docs += len(doc)
            # a frame ends after the document with which it is full
            cut = np.flatnonzero(np.diff(ptr[1:] // cfg.frame, prepend=0)) + 1
            for i, j in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(doc)]])):
                if j > i:
                    for x, y in zip(held, (doc[i:j], np.diff(ptr[i : j + 1]), ids[ptr[i] : ptr[j]])):
                        x.append(y)
                if sum(map(len, held[2])) >= cfg.frame:
                    flush()
        if writer is not None:
            flush()
            writer.close()
            out.close()
            files.move(tmp, target)
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([f"part-{part:06d}.tok"]), pa.array([n_docs]), pa.array([writer.total])], ["part", "file", "n_docs", "n_ids"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    ordered = rows.repartitionByRange(tables.partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return tables.materialise(ordered.mapInArrow(run, "part long, file string, n_docs long, n_ids long"), "op2-manifest")


def read(manifest: DataFrame, folder: str, wanted: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, ids; with ``wanted`` only those documents, from their frames only."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                files, base = _filesystem(folder)
                with files.open_input_file(f"{base}/{row['file']}") as src:
                    reader = Reader(src)
                    before = np.concatenate([[0], np.cumsum(reader.index["n"].astype(np.int64))]) + row["start"]
                    rows: list[tuple] = []
                    for i, doc, ids in reader.documents(wanted):
                        rows.append((None if doc == np.iinfo(np.int64).min else doc, int(before[i]), len(ids), tokens.crc(ids), ids))
                        if len(rows) == 1024:
                            yield _rows(rows)
                            rows = []
                    yield _rows(rows)

    # a row for each file: the running sum is over few rows
    start = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.select("part", "file", start.cast("long").alias("start")).repartition(tables.partitions(manifest.sparkSession), "part")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [(), (), (), (), ()]
    return pa.RecordBatch.from_arrays([*(pa.array(cols[i], pa.int64()) for i in range(4)), K.blobs(cols[4])], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def digest(docs: DataFrame, path: str | None = None, cfg: FileConfig = FileConfig()) -> DataFrame:
    """Writes the files to the shared folder and reads them back, without the ids themselves."""
    folder = tables.fresh_path(docs.sparkSession, "op2-files")
    return read(write(docs, folder, path, cfg), folder).drop("ids")
