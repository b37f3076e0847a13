"""Best-fit packing of token sequences by bin completion over the histogram of lengths.

Whatever the number of documents, pieces have at most ``capacity`` lengths, so
the problem is solved on the histogram. The incumbent: take the largest length
left, search the filling of its gap that wastes least (starting from the best-fit
filling), apply it as often as the counts allow, go on. If that meets the lower
bound it is optimal. Otherwise a branch and bound over bins looks for a solution
with fewer: the largest piece left is completed by each undominated filling in
turn (least waste first), and a branch ends where the waste so far exceeds what
the wanted number of sequences allows. A filling is dominated if one more piece
fits, or if some of its pieces can give way to one larger piece that fits in
their place. Instances of at most ``bins`` sequences are searched whole; of larger ones, whose
incumbents waste next to nothing, the ``bins`` most wasteful sequences. ``nodes`` limits a
search; where it ends one, the incumbent stands and ``plan`` says that it isn't proven.
Every piece then finds its place by its rank among the pieces of its length.

Defined results: null and empty texts are one piece holding the end id; a text longer than a sequence is cut into
pieces; rows that share an id are packed apart, equal ones too; null ids are packed as well; an empty table gives no rows; columns besides doc_id and
text are not read. Ties between lengths go to the first in task and row order.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from plumbline import tables

from . import kernels as K, tokens


@dataclass(frozen=True)
class PackConfig:
    capacity: int = 4096
    end_id: int = 1
    nodes: int = 20000  #: fillings looked at in one search
    bins: int = 96  #: sequences that one search over bins packs anew, at most


def best_fit(gap: int, counts: np.ndarray) -> list[int]:
    """The filling that takes the largest piece that fits, again and again."""
    out, used = [], {}
    size = min(gap, len(counts) - 1)
    while gap > 0 and size > 0:
        fits = np.flatnonzero(counts[1 : min(gap, size) + 1]) + 1
        if not len(fits):
            break
        size = int(fits[-1])
        k = min(gap // size, int(counts[size]) - used.get(size, 0))
        out += [size] * k
        used[size] = k
        gap -= k * size
        size -= 1
    return out


def complete(gap: int, counts: np.ndarray, nodes: int) -> list[int]:
    """The filling of a gap that wastes least, from the counts of lengths."""
    best = best_fit(gap, counts)
    waste = gap - sum(best)
    if not waste or not counts[1 : gap + 1].any():
        return best
    left = nodes
    present = counts > 0

    def pair(g: int, most: int) -> tuple[int, ...] | None:
        """One or two pieces that fill g exactly, none above ``most``."""
        if g <= most and present[g]:
            return (g,)
        lo, hi = max(1, g - most), min(most, g - 1)
        if lo > hi:
            return None
        a = np.arange(hi, (g - 1) // 2, -1)
        a = a[(g - a >= 1) & (g - a <= most)]
        ok = present[a] & present[g - a] & ((a != g - a) | (counts[a] > 1))
        at = int(ok.argmax()) if len(ok) else 0
        return (int(a[at]), int(g - a[at])) if len(ok) and ok[at] else None

    def walk(g: int, most: int, chosen: list[int]) -> bool:
        nonlocal best, waste, left
        left -= 1
        got = pair(g, most)
        if got and all(chosen.count(x) + got.count(x) <= counts[x] for x in got):
            best, waste = [*chosen, *got], 0
            return True
        fits = np.flatnonzero(present[1 : min(g, most) + 1])[::-1] + 1
        if not len(fits):
            if g < waste:
                best, waste = list(chosen), g
            return False
        for a in fits.tolist():
            if left <= 0:
                return False
            if chosen.count(a) >= counts[a]:
                continue
            # a filling whose largest piece is a, of which all fit in any number, can't beat the incumbent
            room = g - a
            small = fits[fits <= a]
            if room > 0 and int((counts[small] * small).sum()) < g - waste:
                return False
            if walk(room, a, [*chosen, a]) if room else _full(chosen, a):
                return True
        return waste == 0

    def _full(chosen: list[int], a: int) -> bool:
        nonlocal best, waste
        best, waste = [*chosen, a], 0
        return True

    walk(gap, gap, [])
    return best


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: the total length, and for each k the pieces that can't share with those of k or more."""
    size = np.arange(len(counts))
    best = -(-int((counts * size).sum()) // capacity)
    n, total = np.cumsum(counts), np.cumsum(counts * size)
    half = capacity // 2
    for k in range(1, half + 1):
        alone = n[-1] - n[min(capacity - k, len(n) - 1)]
        large = n[min(capacity - k, len(n) - 1)] - n[half]
        room = large * capacity - (total[min(capacity - k, len(n) - 1)] - total[half])
        small = total[half] - total[k - 1]
        best = max(best, int(alone + large + max(0, -(-(small - room) // capacity))))
    return best


def fillings(gap: int, counts: np.ndarray, waste: int, tick) -> list[tuple[int, list[int]]]:
    """(waste, pieces) of the undominated fillings of a gap that waste at most ``waste``, least first; ``tick()`` says whether to go on."""
    sizes = (np.flatnonzero(counts[1 : gap + 1]) + 1)[::-1].tolist()
    if not sizes:
        return [(gap, [])] if gap <= waste else []
    if sizes[0] == gap:
        return [(0, [gap])]  # one piece that fits exactly dominates every other filling
    after = np.append(np.cumsum([s * int(counts[s]) for s in sizes][::-1])[::-1], 0).tolist()
    out: list[tuple[int, list[int]]] = []

    def dominated(chosen: list[int], left: int) -> bool:
        used = {s: chosen.count(s) for s in set(chosen)}
        free = [s for s in sizes if counts[s] > used.get(s, 0)]
        if free and free[-1] <= left:
            return True
        sums = set()
        for k in (1, 2, 3):
            sums |= {sum(x) for x in itertools.combinations(chosen, k)}
        # a piece that is larger than some of the chosen together, or as large as several, and fits in their place
        return any(x < y <= x + left or (x == y and x not in used) for x in sums for y in free)

    def walk(i: int, left: int, chosen: list[int]) -> bool:
        if not tick():
            return False
        if left - min(left, after[i]) > waste:
            return True
        while i < len(sizes) and sizes[i] > left:
            i += 1
        if i == len(sizes):
            if left <= waste and not dominated(chosen, left):
                out.append((left, list(chosen)))
            return True
        s = sizes[i]
        for k in range(min(left // s, int(counts[s])), -1, -1):
            if not walk(i + 1, left - k * s, chosen + [s] * k):
                return False
        return True

    walk(0, gap, [])
    out.sort(key=lambda x: x[0])
    return out


def search(counts: np.ndarray, capacity: int, target: int, nodes: int) -> tuple[list[list[int]] | None, bool]:
    """(fillings of at most ``target`` sequences or None, whether the search came to its end)."""
    counts, left = counts.astype(np.int64).copy(), nodes
    spare = target * capacity - int((counts * np.arange(len(counts))).sum())
    done: list[list[int]] = []
    failed: set[tuple] = set()

    def tick() -> bool:
        nonlocal left
        left -= 1
        return left > 0

    def walk(spare: int) -> bool:
        sizes = np.flatnonzero(counts)
        if not len(sizes):
            return True
        state = (spare, sizes.tobytes(), counts[sizes].tobytes())
        if state in failed or not tick():
            return False
        big = int(sizes[-1])
        counts[big] -= 1
        for waste, chosen in fillings(capacity - big, counts, spare, tick):
            for s in chosen:
                counts[s] -= 1
            done.append([big, *chosen])
            if walk(spare - waste):
                return True
            done.pop()
            for s in chosen:
                counts[s] += 1
            if left <= 0:
                break
        counts[big] += 1
        failed.add(state)
        return False

    if spare < 0:
        return None, True
    return (done, True) if walk(spare) else (None, left > 0)


def greedy(counts: np.ndarray, cfg: PackConfig) -> list[tuple[list[int], int]]:
    """(pieces of a sequence, times): the incumbent."""
    counts, out = counts.astype(np.int64).copy(), []
    for big in range(cfg.capacity, 0, -1):
        while counts[big] > 0:
            counts[big] -= 1
            filling = [big, *complete(cfg.capacity - big, counts, min(cfg.nodes, 4000))]
            counts[big] += 1
            sizes, times = np.unique(np.array(filling), return_counts=True)
            m = int((counts[sizes] // times).min())
            counts[sizes] -= m * times
            out.append((filling, m))
    return out


def improve(patterns: list[tuple[list[int], int]], counts: np.ndarray, cfg: PackConfig) -> tuple[list[tuple[list[int], int]], bool]:
    """(patterns, whether they are proven the fewest) after the search over bins."""
    n, low = sum(m for _, m in patterns), lower_bound(counts, cfg.capacity)
    if n <= low:
        return patterns, True
    kept, again = [], []
    for filling, m in sorted(patterns, key=lambda x: sum(x[0])):
        take = min(m, cfg.bins - len(again))
        again += [filling] * take
        if m > take:
            kept.append((filling, m - take))
    part = np.bincount(np.concatenate(again), minlength=len(counts))
    for target in range(max(lower_bound(part, cfg.capacity), len(again) - (n - low)), len(again)):
        found, ended = search(part, cfg.capacity, target, cfg.nodes)
        if found is not None:
            proven = not kept or sum(m for _, m in kept) + len(found) == low
            return [*kept, *((f, 1) for f in found)], proven
        if not ended:
            return patterns, False
    return patterns, not kept


def plan(counts: np.ndarray, cfg: PackConfig) -> tuple[np.ndarray, int, bool]:
    """(slots, number of sequences, whether it is proven the least): slots are rows (length, first rank, ranks, per sequence, first sequence, offset), sorted by length and rank."""
    patterns, proven = improve(greedy(counts, cfg), counts, cfg)
    used = np.zeros(len(counts), np.int64)
    slots, seq = [], 0
    for filling, m in patterns:
        sizes, times = np.unique(np.array(filling), return_counts=True)
        offset = 0
        for size, k in zip(sizes[::-1].tolist(), times[::-1].tolist()):
            slots.append((size, int(used[size]), m * k, k, seq, offset))
            used[size] += m * k
            offset += k * size
        seq += m
    return np.array(sorted(slots), np.int64).reshape(-1, 6), seq, proven


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long"


def pieces(docs: DataFrame, path: str, cfg: PackConfig) -> DataFrame:
    """Every document's pieces with their rank among the task's pieces of equal length."""
    c = cfg.capacity

    def run(batches):
        enc = None
        part = TaskContext.get().partitionId()
        seen = np.zeros(c + 1, np.int64)
        for b, data, off in K.chunks(batches):
            enc = enc or tokens.word_encoder(path)
            ids, ptr = tokens.with_end(*enc.ids(data, off), cfg.end_id)
            n = np.diff(ptr)
            k = -(-n // c)
            doc = np.repeat(np.arange(len(n)), k)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
            start = piece * c
            length = np.minimum(n[doc] - start, c)
            order = np.argsort(length, kind="stable")
            ls = length[order]
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order)) - np.searchsorted(ls, ls) + seen[ls]
            seen += np.bincount(length, minlength=c + 1)
            crc = [tokens.crc(ids[a : a + m]) for a, m in zip((ptr[doc] + start).tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part)), pa.array(rank)], [x.split()[0] for x in _PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PIECES)


def pack(docs: DataFrame, path: str | None = None, cfg: PackConfig = PackConfig()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    spark = docs.sparkSession
    made = tables.materialise(pieces(docs, path or tokens.default_path(), cfg), "op10-pieces")
    counts = tables.materialise(made.groupBy("part", "length").agg(F.count("*").alias("n")), "op10-counts")
    hist = np.zeros(cfg.capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most one row for each length
        hist[row.length] = row.n
    slots = plan(hist, cfg)[0]
    sent = spark.sparkContext.broadcast(slots)  # at most a slot for each two lengths of a pattern, whatever the input
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def place(batches):
        s = sent.value
        key = (s[:, 0] << 48) + s[:, 1]
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(key, (length << 48) + rank, "right") - 1
            r = rank - s[at, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(s[at, 4] + r // s[at, 3]), pa.array(s[at, 5] + r % s[at, 3] * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = made.join(first, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
