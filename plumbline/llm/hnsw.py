"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard, results merged.

Equal vectors are one entry (with their smallest ids), so a very common vector
neither fills a graph nor a result. Entries are dealt to shards of about
``shard`` vectors by hash. A shard's graph is built by insertion: vectors come in
random order in batches that at most double the graph; a batch searches the
graph as it stands, a block of vectors in step, and links with what it finds
and with near vectors of its own batch. The diversity rule chooses up to M
links, reverse links are pruned by the same rule. Levels follow the usual exponential law.
A shard is one file in the shared folder: vectors, ids, and for each level one flat array of neighbour
numbers. A search descends greedily and runs a beam of ``ef`` on the lowest level.
Vectors get one extra coordinate that makes their lengths equal, so largest inner product and nearest coincide.

Blocks of queries are sent to the shards; a task reads a shard's file once for all its blocks.

Defined results: vectors null, empty, zero, or with null or non-finite components take no part, neither do null ids; a query
meets vectors of its own dimension only; equal rows count once; rows that share an id but not the vector are separate candidates, none of which is
returned for a query of that id; an id that asks with several vectors has one ranking of all answers; ties go to the smaller id; an empty table gives no rows; columns besides vec_id and embedding are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from plumbline import tables

from . import kernels as K

#: Fills places of ids; no row's id.
_NONE = np.iinfo(np.int64).min


@dataclass(frozen=True)
class HnswConfig:
    shard: int = 1 << 14  #: vectors of one graph, on average
    m: int = 16  #: links of a node on upper levels, twice as many on the lowest
    build: int = 80  #: beam of an insertion
    batch: int = 1024  #: vectors inserted at once
    ef: int = 160  #: beam of a search
    wide: int = 8  #: nodes of a beam opened in one step
    step: int = 256  #: vectors that search in step
    block: int = 2048  #: queries sent together


def _dots(y: np.ndarray, at: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Products of y[at] (rows of several) with q (one for each row)."""
    return np.matmul(y[at], q[:, :, None])[:, :, 0]


def _beam(y: np.ndarray, links: np.ndarray, at: np.ndarray, q: np.ndarray, ef: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, products) of a beam of ``ef`` on one level from the nodes ``at``, best first; -1 where there are fewer."""
    b, n = len(q), len(y)
    wide = min(wide, ef)
    rows = np.arange(b)
    ids, scores = np.full((b, ef), -1, np.int32), np.full((b, ef), -np.inf, np.float32)
    opened, seen = np.ones((b, ef), bool), np.zeros((b, n), bool)
    ids[:, 0], scores[:, 0], opened[:, 0] = at, np.einsum("ij,ij->i", y[at], q), False
    seen[rows, at] = True
    live = rows
    while len(live):
        s = np.where(opened[live], -np.inf, scores[live])
        pick = np.argpartition(-s, wide - 1, axis=1)[:, :wide] if wide < ef else np.arange(ef)[None].repeat(len(live), 0)
        going = np.take_along_axis(s, pick, 1) > -np.inf
        on = going.any(1)
        live, pick, going = live[on], pick[on], going[on]
        if not len(live):
            break
        opened[live[:, None], pick] = True
        nb = np.where(going[:, :, None], links[ids[live[:, None], pick]], -1).reshape(len(live), -1)
        new = (nb >= 0) & ~seen[live[:, None], nb]
        # a node met from two sides counts once
        r, c = np.nonzero(new)
        flat = r * n + nb[r, c]
        once = np.unique(flat, return_index=True)[1]
        r, c = r[once], c[once]
        node = nb[r, c]
        seen[live[r], node] = True
        got = np.full(nb.shape, -np.inf, np.float32)
        got[r, c] = np.einsum("ij,ij->i", y[node], q[live[r]])
        all_s = np.concatenate([scores[live], got], 1)
        keep = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
        scores[live] = np.take_along_axis(all_s, keep, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], nb], 1), keep, 1)
        opened[live] = np.take_along_axis(np.concatenate([opened[live], got == -np.inf], 1), keep, 1)
    ids[scores == -np.inf] = -1
    order = np.argsort(-scores, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def _diverse(y: np.ndarray, near: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """Up to m of each row's candidates (best first, -1 for none), leaving out those nearer to a chosen one than to the row; free places take the nearest left."""
    n, c = near.shape
    out = np.full((n, m), -1, np.int32)
    for lo in range(0, n, 512):
        ids, own = near[lo : lo + 512], sims[lo : lo + 512]
        v = y[ids]
        closer = np.matmul(v, v.transpose(0, 2, 1)) > own[:, :, None]
        took, used = np.zeros(ids.shape, bool), np.zeros(len(ids), np.int64)
        for r in range(c):
            ok = (ids[:, r] >= 0) & (used < m) & ~(closer[:, r] & took).any(1)
            took[:, r] = ok
            used += ok
        rank = np.where(ids < 0, 2 * c, np.where(took, 0, c) + np.arange(c))
        pick = np.argsort(rank, axis=1, kind="stable")[:, :m]
        out[lo : lo + 512, : pick.shape[1]] = np.take_along_axis(ids, pick, 1)
    return out


def _link(y: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Links from ``new`` to ``chosen`` and back; full lists are chosen anew."""
    m = links.shape[1]
    links[new, : chosen.shape[1]] = chosen
    src, dst = np.repeat(new, chosen.shape[1]), chosen.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    known = (links[dst] == src[:, None]).any(1)
    src, dst = src[~known], dst[~known]
    if not len(src):
        return
    sims = np.einsum("ij,ij->i", y[src], y[dst])
    order = np.lexsort((-sims, dst))
    src, dst = src[order], dst[order]
    target, first = np.unique(dst, return_index=True)
    place = np.arange(len(dst)) - np.repeat(first, np.diff(np.append(first, len(dst))))
    few = place < m  # as many as a list can hold, nearest first
    more = np.full((len(target), int(place[few].max()) + 1), -1, np.int32)
    more[np.searchsorted(target, dst[few]), place[few]] = src[few]
    every = np.concatenate([links[target], more], 1)
    s = np.where(every >= 0, _dots(y, every, y[target]), -np.inf)
    order = np.argsort(-s, axis=1, kind="stable")
    every, s = np.take_along_axis(every, order, 1), np.take_along_axis(s, order, 1)
    full = (every >= 0).sum(1) > m
    links[target[~full]] = every[~full][:, :m] if every.shape[1] >= m else np.pad(every[~full], ((0, 0), (0, m - every.shape[1])), constant_values=-1)
    if full.any():
        links[target[full]] = _diverse(y, every[full], s[full], m)


def augmented(x: np.ndarray) -> np.ndarray:
    """Vectors with a coordinate more, of equal length."""
    norm2 = (x * x).sum(1)
    return np.concatenate([x, np.sqrt(np.maximum(norm2.max() - norm2, 0))[:, None]], 1).astype(np.float32)


def build(x: np.ndarray, seed: np.ndarray, cfg: HnswConfig) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the lowest: (node numbers, flat neighbour array of node numbers, -1 for none); nodes are inserted in the order given."""
    n, y = len(x), augmented(x)
    u = np.clip((K.mix(seed).astype(np.float64) + 0.5) / 2.0**64, 1e-18, 1 - 1e-12)
    level = np.floor(-np.log(u) / np.log(cfg.m)).astype(int)
    level[0] = level.max()  # every search starts at the first node
    links = [np.full((n, cfg.m * (1 if at else 2)), -1, np.int32) for at in range(int(level[0]) + 1)]
    done = 1
    while done < n:
        new = np.arange(done, min(n, done + min(done, cfg.batch)))
        at = np.zeros(len(new), np.int64)
        for up in range(len(links) - 1, -1, -1):
            mine = level[new] >= up
            found = np.full((len(new), cfg.build), -1, np.int32)
            sims = np.full((len(new), cfg.build), -np.inf, np.float32)
            for which, ef in ((mine, cfg.build), (~mine, 1)):
                who = np.flatnonzero(which)
                for lo in range(0, len(who), cfg.step):
                    w = who[lo : lo + cfg.step]
                    i, s = _beam(y[:done], links[up][:done], at[w], y[new[w]], ef, cfg.wide)
                    found[w, : i.shape[1]], sims[w, : i.shape[1]] = i, s
            at = found[:, 0].astype(np.int64)
            own = new[mine]
            if len(own):
                near, s = found[mine], sims[mine]
                if len(own) > 1:  # those of the batch itself
                    both = y[own] @ y[own].T
                    np.fill_diagonal(both, -np.inf)
                    c = min(cfg.m, len(own) - 1)
                    pick = np.argpartition(-both, c - 1, axis=1)[:, :c]
                    near = np.concatenate([near, own[pick].astype(np.int32)], 1)
                    s = np.concatenate([s, np.take_along_axis(both, pick, 1)], 1)
                order = np.argsort(-s, axis=1, kind="stable")[:, : cfg.build]
                near, s = np.take_along_axis(near, order, 1), np.take_along_axis(s, order, 1)
                _link(y, links[up], own, _diverse(y, near, s, cfg.m))
        done = int(new[-1]) + 1
    return [(np.flatnonzero(level >= up), table[level >= up]) for up, table in enumerate(links)]


def search(x: np.ndarray, levels: list, q: np.ndarray, k: int, cfg: HnswConfig) -> np.ndarray:
    """For each query the numbers of its k best vectors found (-1: fewer)."""
    y = np.ascontiguousarray(x, np.float32)
    q = np.ascontiguousarray(q, np.float32)
    at = np.zeros(len(q), np.int64)
    for nodes, links in levels[:0:-1]:
        place = np.searchsorted(nodes, at)
        score = np.einsum("ij,ij->i", y[at], q)
        live = np.arange(len(q))
        while len(live):
            nb = links[place[live]]
            s = np.where(nb >= 0, _dots(y, nb, q[live]), -np.inf)
            best = s.argmax(1)
            top = s[np.arange(len(live)), best]
            on = top > score[live]
            live, node, top = live[on], nb[np.arange(len(nb)), best][on], top[on]
            at[live], score[live] = node, top
            place[live] = np.searchsorted(nodes, node)
    return _beam(y, levels[0][1], at, q, min(max(cfg.ef, k), len(y)), cfg.wide)[0][:, :k]


def _valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) with vectors as arrays of doubles."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _store(folder: str, shard: int, arrays: list[np.ndarray]) -> str:
    """Writes a shard's arrays to a file of its own; a repeated task leaves one file."""
    from pyarrow import fs

    files, base = fs.FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)
    path = f"{base}/shard-{shard:012d}.hnsw"
    mine = f"{path}.{TaskContext.get().taskAttemptId()}.tmp"
    with files.open_output_stream(mine) as f:
        np.save(f, np.array([len(arrays)]))
        for a in arrays:
            np.save(f, a)
    files.move(mine, path)
    return path.rsplit("/", 1)[1]


def _load(folder: str, name: str) -> list[np.ndarray]:
    import io

    from pyarrow import fs

    files, base = fs.FileSystem.from_uri(folder)
    with files.open_input_file(f"{base}/{name}") as f:
        raw = io.BytesIO(f.read())
    return [np.load(raw) for _ in range(int(np.load(raw)[0]))]


_INDEX = "shard long, dim int, file string, n long"


def index(vectors: DataFrame, folder: str, k: int, cfg: HnswConfig = HnswConfig()) -> DataFrame:
    """One row per shard: its file holds its vectors, the k + 1 smallest ids of each, and the graph's flat arrays."""
    # equal rows count once; the window's limit works before its exchange, so a very common vector isn't gathered
    ranked = _valid(vectors).distinct().withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    unique = tables.materialise(ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "op9-unique")
    shards = max(1, -(-unique.count() // cfg.shard))

    def make(t: pa.Table) -> pa.Table:
        seed = t.column("seed").to_numpy()
        x = _matrix(t.column("v"))
        lists = t.column("ids").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        ids = np.full((len(x), k + 1), _NONE, np.int64)
        ids[np.repeat(np.arange(len(x)), size), K.ranges(np.zeros(len(size), np.int64), size)] = lists.flatten().to_numpy()
        order = np.lexsort((ids[:, 0], seed))  # a random order, the same at every attempt
        x, ids, seed = x[order], ids[order], seed[order].view(np.uint64)
        graph = build(x, seed, cfg)
        name = _store(folder, shard := t.column("shard")[0].as_py(), [x, ids, *(a for pair in graph for a in pair)])
        return pa.table({"shard": pa.array([shard]), "dim": pa.array([x.shape[1]], pa.int32()), "file": pa.array([name]), "n": pa.array([len(x)], pa.int64())})

    seed = F.xxhash64("v")
    placed = unique.select("v", "ids", seed.alias("seed"), F.size("v").alias("dim"), F.pmod(F.xxhash64(seed), F.lit(shards)).alias("part"))
    keyed = placed.select("v", "ids", "seed", (F.col("dim").cast("long") * shards + F.col("part")).alias("shard"))
    out = tables.materialise(keyed.groupBy("shard").applyInArrow(make, _INDEX), "op9-index")
    tables.drop_tables(vectors.sparkSession, unique)
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, cfg: HnswConfig = HnswConfig()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every query, the query's own id left out."""
    spark = vectors.sparkSession
    folder = tables.fresh_path(spark, "op9-shards")
    built = index(vectors, folder, k, cfg)
    # a name for each shard, so a row for every ``shard`` vectors: the queries go there, the shards stay where they are
    where: dict[int, list[tuple[int, str]]] = {}
    for row in built.select("shard", "dim", "file").collect():
        where.setdefault(row.dim, []).append((row.shard, row.file))
    asked = _valid(queries).distinct()
    blocks = max(1, -(-asked.count() // cfg.block))

    def pack(t: pa.Table) -> pa.Table:
        q = _matrix(t.column("v"))
        to = where.get(q.shape[1], [])
        n = len(to)
        return pa.table({"shard": pa.array([s for s, _ in to], pa.int64()), "file": pa.array([f for _, f in to], pa.string()), "qids": pa.array([t.column("vec_id").to_numpy().tobytes()] * n, pa.binary()), "q": pa.array([q.tobytes()] * n, pa.binary())})

    packed = asked.withColumn("dim", F.size("v")).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).groupBy("dim", "block").applyInArrow(pack, "shard long, file string, qids binary, q binary")

    def run(batches):
        held = None
        for batch in batches:
            for row in batch.to_pylist():
                if held is None or held[0] != row["shard"]:
                    x, ids, *flat = _load(folder, row["file"])
                    held = row["shard"], x, np.ascontiguousarray(x, np.float32), ids, list(zip(flat[0::2], flat[1::2]))
                _, x, x32, ids, graph = held
                q, qids = np.frombuffer(row["q"]).reshape(-1, x.shape[1]), np.frombuffer(row["qids"], np.int64)
                for lo in range(0, len(q), cfg.step):
                    own, many = qids[lo : lo + cfg.step], q[lo : lo + cfg.step]
                    got = search(x32, graph, many, k + 1, cfg)
                    r, c = np.nonzero(got >= 0)
                    node = got[r, c]
                    score = (x[node] * many[r]).sum(1)
                    vec = ids[node]
                    r, score = np.repeat(r, k + 1), np.repeat(score, k + 1)
                    vec = vec.ravel()
                    ok = (vec != _NONE) & (vec != own[r])
                    r, score, vec = r[ok], score[ok], vec[ok]
                    order = np.lexsort((vec, -score, r))
                    r, score, vec = r[order], score[order], vec[order]
                    place = np.arange(len(r)) - np.searchsorted(r, r)
                    top = place < k
                    yield pa.RecordBatch.from_arrays([pa.array(own[r[top]]), pa.array(vec[top]), pa.array(score[top])], ["query_id", "vec_id", "score"])

    # the stated set of queries against all rows: every block of queries visits every shard of its dimension
    dealt = packed.repartition(tables.partitions(spark), "shard").sortWithinPartitions("shard")
    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
