"""N-gram Jaccard join by prefix lists with set-relation skipping.

Documents are sets of word shingles (64-bit hashes). Sets are ordered by one
global order (shingles that a bounded sample finds often come last, then by
hash; any order gives the same answers), and only the first
n - ceil(t n) + 1 of n shingles are indexed: two sets that link share one of these.

* Index level: the lists hold (size, position). A list is sorted by size, and
  the position of a row bounds the overlap still possible, hence the largest
  partner; all rows past that reach are skipped without being looked at.
* Answer level: equal sets are one class. Any other set takes a *pivot*, a set
  like it: the smallest document of the longest list it stands in. It is kept as
  its difference from the pivot, so its answers come from the pivot's: the
  distance of x and y is that of their differences, exactly, without the sets.
  Sets of one pivot meet once (not once for each list), are decided in the task
  and only links that join two groups leave it. The lists then hold what is
  left: rows that have a partner of another pivot and another group.

Pairs within reach are pruned by parity sketches (differing bits never exceed
the symmetric difference). Pairs of two pivots are verified on whole sets. Long
lists and large groups are cut into blocks, so a task holds blocks, never a whole list.

Words over ``kernels.LONG`` bytes are hashed by xxh3, shorter ones and the
shingles (a few words each) by random polynomials; equal 64-bit hashes count as equal.

Defined results: null and empty texts and texts without words have no shingles
and link with nothing; very long texts are sets like others; rows that share an id are one
node, linked with what any of them is linked with; null ids form no links and have a null component; an empty
table gives no rows; columns besides doc_id and text are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from plumbline import tables
from plumbline.operators.graph import connected_components

from . import anchors, kernels as K

U64 = K.U64
#: Tasks that a class of equal sets is dealt to.
_SALTS = 16


@dataclass(frozen=True)
class JaccardConfig:
    shingle: int = 4
    percent: int = 85  #: documents link when 100 * intersection >= percent * union
    block: int = 2048  #: rows of a list or of a pivot's group that one task compares with another block
    hold: int = 1 << 15  #: rows that a task takes in at a time, more only where one block has more
    sample: int = 8192  #: documents whose shingle counts order the index, at most
    hint: int = 1 << 18  #: shingles whose place in the order the sample decides, at most


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the distinct n-word shingles of each document, ascending; of fewer words the whole sequence."""
    s, e, ptr = K.word_spans(data, off)
    words = np.diff(ptr)
    sums = K.prefix(K.words(data, s, e, fold=True))
    count = np.where(words >= n, words - n + 1, (words > 0).astype(np.int64))
    first = K.ranges(ptr[:-1], count)
    doc = np.repeat(np.arange(len(words)), count)
    h = K.spans(sums, first, np.minimum(first + n, ptr[1:][doc]))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
    return h[new], np.searchsorted(doc[new], np.arange(len(words) + 1))


def need(n1, n2, percent: int):
    """The least intersection with which sets of these sizes link."""
    return -(-percent * (n1 + n2) // (100 + percent))


def _order_hint(docs: DataFrame, cfg: JaccardConfig) -> np.ndarray:
    """Shingles found often in a sample of documents, sorted; at most cfg.hint of them."""
    total = docs.count()
    share = min(1.0, 0.95 * cfg.sample / max(total, 1))
    picked = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) < int(share * (1 << 20)))

    def count(batches):
        found = [shingle_sets(data, off, cfg.shingle)[0] for _, data, off in K.chunks(batches)]
        if found:
            h, n = np.unique(np.concatenate(found), return_counts=True)
            h, n = h[n > 2], n[n > 2]
            yield pa.RecordBatch.from_arrays([K.blobs([np.sort(h[np.argsort(-n, kind="stable")[: cfg.hint]])])], ["h"])

    got = picked.repartition(1).mapInArrow(count, "h binary").collect()
    return np.frombuffer(got[0].h, U64) if got else np.zeros(0, U64)


def _member(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    at = np.searchsorted(table, x)
    at[at == len(table)] = 0
    return table[at] == x


def parity_sketch(h: np.ndarray) -> np.ndarray:
    """As many bits as the next power of two above the set's size (64 at least); a bit is the parity of the shingles that fall on it."""
    bits = 1 << max(6, int(len(h)).bit_length())
    odd = np.bincount((h & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


_SIGNED = "doc_id long, n long, s1 long, s2 long, prefix binary, sketch binary"


def signed(docs: DataFrame, cfg: JaccardConfig) -> DataFrame:
    """Per row: set size, a 128-bit signature of the set, its indexed shingles in order, and its sketch."""
    sent = docs.sparkSession.sparkContext.broadcast(_order_hint(docs, cfg))

    def run(batches):
        often = sent.value
        for b, data, off in K.chunks(batches):
            h, ptr = shingle_sets(data, off, cfg.shingle)
            n = np.diff(ptr)
            late = _member(often, h)
            doc = K.owners(ptr)
            order = np.lexsort((h, late, doc))
            ordered = h[order]
            sig = _signature(h, ptr)
            size = np.where(n > 0, n - -(-cfg.percent * n // 100) + 1, 0)
            prefix = [ordered[p : p + k] for p, k in zip(ptr[:-1], size)]
            sketch = [parity_sketch(h[p:q]) for p, q in zip(ptr[:-1], ptr[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sig[0]), pa.array(sig[1]), K.blobs(prefix), K.blobs(sketch)], ["doc_id", "n", "s1", "s2", "prefix", "sketch"])

    return docs.mapInArrow(run, _SIGNED)


_POSTINGS = "tok long, doc long, n long, pos long"


def _postings(reps: DataFrame) -> DataFrame:
    """One row for each indexed shingle that another document indexes too."""

    def extract(batches):
        for b in batches:
            p = [np.frombuffer(x.as_buffer(), U64) for x in b.column(1)]
            yield (np.concatenate(p), np.repeat(K.ids_column(b), [len(x) for x in p])) if p else (np.zeros(0, U64), np.zeros(0, np.int64))

    def rows(batches):
        for b in batches:
            tok, at, pos = [], [], []
            for i, (p, told) in enumerate(zip(b.column(2), b.column(3))):
                p = np.frombuffer(p.as_buffer(), U64)
                k = np.flatnonzero(_member(np.frombuffer(told.as_buffer(), U64), p & anchors._FP))
                tok.append(p[k])
                pos.append(k)
                at.append(np.full(len(k), i))
            if tok:
                at = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tok).view(np.int64)), b.column(0).take(at), b.column(1).take(at), pa.array(np.concatenate(pos))], ["tok", "doc", "n", "pos"])

    reps = reps.select(F.col("doc").alias("doc_id"), "n", "prefix")
    shared = anchors.meeting(reps.select("doc_id", "prefix"), extract, inside=False)
    return anchors.with_blobs(reps, shared, "fps", "inner").mapInArrow(rows, _POSTINGS)


def _fold(words: list[np.ndarray], bits: int) -> np.ndarray:
    """Sketches as rows of 64-bit words, cut down to ``bits`` bits."""
    out = np.empty((len(words), bits // 64), U64)
    for i, w in enumerate(words):
        while len(w) > bits // 64:
            w = w[: len(w) // 2] ^ w[len(w) // 2 :]
        out[i] = w
    return out


def _in_turn(batches, cfg: JaccardConfig):
    """Sorted rows as tables of about cfg.hold rows that end where a key ends."""
    held, rows = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= cfg.hold:
            t = pa.Table.from_batches(held)
            key = t.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield t.slice(0, cut)
                held, rows = t.slice(cut).to_batches(), len(key) - cut
    if rows:
        yield pa.Table.from_batches(held)


class _Groups:
    """Labels of rows, merged as links are found."""

    def __init__(self, label: np.ndarray) -> None:
        names, self.of = np.unique(label, return_inverse=True)
        self.root = np.arange(len(names))

    def join(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Merges the labels of the rows; which of the pairs were needed for it."""
        root, kept = self.root, np.zeros(len(i), bool)
        for k, (a, b) in enumerate(zip(self.of[i].tolist(), self.of[j].tolist())):
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
                kept[k] = True
        while (root != root[root]).any():
            root = root[root]
        self.root, self.of = np.arange(len(root)), root[self.of]
        return kept


def _met(t: pa.Table, cfg: JaccardConfig, within: bool) -> np.ndarray:
    """(a, b) of one table of rows with key, doc, n, pos, grp, side, piv, sketch and, with ``within``, delta.

    Rows of equal key meet, side 0 with side 0 and 1, side 1 with side 0. ``within``: all rows of a key have one pivot; links
    that join two groups. Otherwise: pairs of two groups and two pivots that the sketches leave open.
    """
    key, doc, n, pos, grp, side, piv = (t.column(c).to_numpy() for c in ("key", "doc", "n", "pos", "grp", "side", "piv"))
    order = np.lexsort((pos, doc, n, key))
    key, doc, n, pos, grp, side, piv = (x[order] for x in (key, doc, n, pos, grp, side, piv))
    first = np.zeros(len(doc), np.int64)
    by = np.lexsort((n, doc))
    head = np.concatenate([[True], (doc[by][1:] != doc[by][:-1]) | (n[by][1:] != n[by][:-1])])
    first[by] = np.cumsum(head) - 1  # number of the row's document among those here
    code = by[head]
    cols = t.column("sketch").combine_chunks()
    words = [np.frombuffer(cols[int(order[i])].as_buffer(), U64) for i in code]
    width = np.array([len(w) * 64 for w in words])
    if within:
        raw = t.column("delta").combine_chunks()
        parts = [np.frombuffer(raw[int(order[i])].as_buffer(), U64) for i in code]
        size = np.array([len(p) for p in parts])
        at_delta = np.cumsum(size) - size
        number = np.unique(np.concatenate([np.zeros(0, U64), *parts]), return_inverse=True)[1].astype(np.int64)
    folded: dict[int, tuple] = {}
    last = np.flatnonzero(np.append(key[1:] != key[:-1], True)) + 1
    end = last[np.searchsorted(last, np.arange(len(key)), "right")]
    # a row's position bounds its partners' size: beyond, the list is skipped
    most = (100 + cfg.percent) * (n - pos) // cfg.percent - n
    span = int(n.max()) + 2
    rank = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    reach = np.minimum(np.searchsorted(rank * span + n, rank * span + np.minimum(most, span - 1), "right"), end)
    groups, found = _Groups(grp), []

    def linked(i, j):
        """Whether the sets link, from their differences to the pivot."""
        out = []
        for lo in range(0, len(i), 4096):
            x, y = first[i[lo : lo + 4096]], first[j[lo : lo + 4096]]
            both = np.concatenate([x, y])
            pair = np.tile(np.arange(len(x)), 2)
            k = np.sort(np.repeat(pair, size[both]) << 32 | number[K.ranges(at_delta[both], size[both])])
            common = np.bincount(k[1:][k[1:] == k[:-1]] >> 32, minlength=len(x))
            total = n[i[lo : lo + 4096]] + n[j[lo : lo + 4096]]
            apart = size[x] + size[y] - 2 * common
            out.append((100 + cfg.percent) * (total - apart) >= 2 * cfg.percent * total)
        return np.concatenate(out)

    def look(i, j):
        ok = (groups.of[i] != groups.of[j]) & (doc[i] != doc[j]) & (side[i] + side[j] < 2)
        if not within:
            ok &= piv[i] != piv[j]
        must = need(n[i], n[j], cfg.percent)
        ok &= np.minimum(n[i] - pos[i], n[j] - pos[j]) >= must
        i, j, must = i[ok], j[ok], must[ok]
        if not len(i):
            return
        bits = np.minimum(width[first[i]], width[first[j]])
        for w in np.unique(bits):
            if w not in folded:
                wide = np.flatnonzero(width >= w)
                at = np.full(len(width), -1)
                at[wide] = np.arange(len(wide))
                folded[w] = (_fold([words[x] for x in wide], int(w)), at)
            table, at = folded[w]
            for lo in range(0, len(i), 1 << 16):
                m = np.flatnonzero(bits[lo : lo + (1 << 16)] == w) + lo
                if len(m):
                    apart = np.bitwise_count(table[at[first[i[m]]]] ^ table[at[first[j[m]]]]).sum(1)
                    m = m[apart <= n[i[m]] + n[j[m]] - 2 * must[m]]
                    if within and len(m):
                        m = m[linked(i[m], j[m])]
                        if len(m):
                            m = m[groups.join(i[m], j[m])]
                    if len(m):
                        found.append(np.stack([np.minimum(doc[i[m]], doc[j[m]]), np.maximum(doc[i[m]], doc[j[m]])], 1))

    live, d = np.flatnonzero(reach > np.arange(len(key)) + 1), 1
    while len(live):
        look(live, live + d)
        d += 1
        live = live[reach[live] > live + d]
        if len(found) > 64 and sum(map(len, found)) > 1 << 20:
            found[:] = [np.unique(np.concatenate(found), axis=0)]
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def _meet(lists: DataFrame, cfg: JaccardConfig, within: bool) -> DataFrame:
    """(a, b) with a < b of the rows of equal key, see ``_met``."""

    def run(batches):
        for t in _in_turn(batches, cfg):
            p = _met(t, cfg, within)
            if len(p):
                yield pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], ["a", "b"])

    cols = ["key", "doc", "n", "pos", "grp", "side", "piv", "sketch"] + ["delta"] * within
    # no fixed number of tasks: adaptive execution joins small ones
    dealt = lists.select(*cols).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _signature(h: np.ndarray, ptr: np.ndarray) -> list[np.ndarray]:
    """A 128-bit signature of each set, as two columns."""
    sums = [np.concatenate([np.zeros(1, U64), np.cumsum(K.mix(h ^ U64(salt)))]) for salt in (0x51, 0xA7C3)]
    return [(x[ptr[1:]] - x[ptr[:-1]]).view(np.int64) for x in sums]


def _sets(docs: DataFrame, pivoted: DataFrame, several: DataFrame, cfg: JaccardConfig) -> DataFrame:
    """``pivoted`` (doc and other columns) with h, each node's whole set."""

    def sets(batches):
        for b, data, off in K.chunks(batches):
            h, ptr = shingle_sets(data, off, cfg.shingle)
            made = {"__n": pa.array(np.diff(ptr)), "s1": pa.array(_signature(h, ptr)[0]), "s2": pa.array(_signature(h, ptr)[1]), "h": K.blobs([h[p:q] for p, q in zip(ptr[:-1], ptr[1:])])}
            kept = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *made.values()], [*kept, *made])

    def made(rows: DataFrame) -> DataFrame:
        kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
        own = rows.mapInArrow(sets, f"{kept}, __n long, s1 long, s2 long, h binary")
        return own.drop("n", "doc").withColumnRenamed("__n", "n")

    # the same plan at every size: the ids would be broadcast on small inputs only
    first = _noded(made(docs.join(pivoted.hint("merge"), F.col("doc_id") == F.col("doc"))), several).where("doc = doc_id")
    # rows beyond the first set of their id
    others = docs.join(several.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").withColumn("doc", F.lit(0).cast("long"))
    for c, t in pivoted.dtypes:
        if c != "doc":
            others = others.withColumn(c, F.lit(None).cast(t))
    others = _noded(made(others), several).where("doc != doc_id").select("doc", "h").join(pivoted, "doc")
    cols = [*pivoted.columns, "h"]
    # equal rows of an id give equal rows here, which change no link
    return first.select(*cols).unionByName(others.select(*cols))


def _noded(rows: DataFrame, several: DataFrame) -> DataFrame:
    """Rows with their node ``doc``: the id for the first set of an id, a number beyond every id for others."""
    beyond = F.lit(1 << 62) + F.xxhash64("doc_id", "s1", "s2", "n").bitwiseAND(F.lit((1 << 61) - 1))
    first = F.col("f").isNull() | (F.col("f") == F.struct("s1", "s2", "n"))
    return rows.join(several, F.col("doc_id") == F.col("id"), "left").withColumn("doc", F.when(first, F.col("doc_id")).otherwise(beyond)).drop("id", "f")


def _pivots(lists: DataFrame, sketches: DataFrame) -> DataFrame:
    """(doc, piv): documents with the smallest document of their longest list, or with that one's own pivot, where the sketches are alike."""
    heads = lists.groupBy("tok").agg(F.count("*").alias("rows"), F.min("doc").alias("head"))
    own = lists.join(heads, "tok").groupBy("doc").agg((-F.max(F.struct("rows", (-F.col("head")).alias("m")))["m"]).alias("p"))
    jump = own.join(own.select(F.col("doc").alias("p"), F.col("p").alias("q")), "p", "left").select("doc", F.array(F.coalesce("q", "p"), "p").alias("try"))
    asked = jump.select("doc", F.posexplode(F.array_distinct("try")).alias("nth", "piv")).where("piv != doc")
    other = sketches.select(F.col("doc").alias("piv"), F.col("sketch").alias("other"))

    def alike(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(z.as_buffer(), U64) for z in (x, y))
                w = min(len(x), len(y))
                ok.append(4 * w * 64 >= 10 * int(np.bitwise_count(np.bitwise_xor(*_fold([x, y], w * 64))).sum()))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in (0, 1, 4)], ["doc", "piv", "nth"]).filter(pa.array(ok, pa.bool_()))

    near = asked.join(sketches.select("doc", "sketch"), "doc").join(other, "piv").select("doc", "piv", "sketch", "other", "nth").mapInArrow(alike, "doc long, piv long, nth int")
    return near.groupBy("doc").agg(F.min(F.struct("nth", "piv"))["piv"].alias("piv"))


def _with_pivots(sketches: DataFrame, best: DataFrame) -> DataFrame:
    """(doc, n, piv, sketch, rows, heads): a document without a pivot is its own.

    ``rows`` counts the documents of its pivot, ``heads`` those whose pivot it is (null: none), the pivot itself among them.
    """
    size = best.groupBy("piv").agg((F.count("*") + 1).alias("rows"))
    own = sketches.join(best.join(size, "piv"), "doc", "left").join(size.select(F.col("piv").alias("doc"), F.col("rows").alias("heads")), "doc", "left")
    return own.select("doc", "n", F.coalesce("piv", "doc").alias("piv"), "sketch", "rows", "heads")


def _deltas(sets: DataFrame, cfg: JaccardConfig) -> DataFrame:
    """(doc, n, piv, sketch, delta, rows): differences to the pivot's set; ``rows`` have the pivot. A pivot that others have stands here with an empty difference."""
    pivots = sets.where("heads IS NOT NULL").select(F.col("doc").alias("piv"), "n", "sketch", F.col("heads").alias("rows"), F.col("h").alias("hp"))
    salts = F.ceil(F.col("rows") / cfg.block)
    # a pivot with very many documents goes to several tasks
    head = pivots.select("piv", "hp", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    rows = sets.where("piv != doc").withColumn("salt", F.pmod(F.xxhash64("doc"), salts))

    def differ(batches):
        for b in batches:
            made = [np.setxor1d(np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64), assume_unique=True) for x, y in zip(b.column(5), b.column(6))]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], K.blobs(made)], ["doc", "n", "piv", "sketch", "rows", "delta"])

    cols = ["doc", "n", "piv", "sketch", "rows", "delta"]
    made = rows.join(head.hint("merge"), ["piv", "salt"]).select("doc", "n", "piv", "sketch", "rows", "h", "hp").mapInArrow(differ, "doc long, n long, piv long, sketch binary, rows long, delta binary")
    # a pivot that has a pivot of its own meets its own documents as well
    return made.unionByName(pivots.select(F.col("piv").alias("doc"), "n", "piv", "sketch", "rows", F.lit(b"").alias("delta")).select(*cols))


def _verified(sets: DataFrame, pairs: DataFrame, cfg: JaccardConfig) -> DataFrame:
    """The pairs whose whole sets link."""
    a, b = (sets.select(F.col("doc").alias(x), F.col("h").alias("h" + x)) for x in "ab")

    def run(batches):
        for t in batches:
            ok = []
            for x, y in zip(t.column(2), t.column(3)):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append((100 + cfg.percent) * both >= cfg.percent * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays(t.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long")


def _across(rows: DataFrame, list_: str, cfg: JaccardConfig) -> DataFrame:
    """Lists laid out in blocks so that every two rows of different groups meet once at least, in rows with key and side.

    The largest group of a list doesn't meet itself: with ``small`` other rows,
    its blocks go to each block of those only.
    """
    by = rows.groupBy(list_, "grp").agg(F.count("*").alias("c")).groupBy(list_).agg(F.sum("c").alias("all"), F.max(F.struct("c", "grp")).alias("top"), F.count("*").alias("groups"))
    by = by.where("groups > 1").select(list_, (F.col("all") - F.col("top.c")).alias("small"), F.col("top.c").alias("big"), F.col("top.grp").alias("main"))
    ns, nb = F.ceil(F.col("small") / cfg.block), F.ceil(F.col("big") / cfg.block)
    side = (F.col("grp") == F.col("main")).cast("int")
    h = F.pmod(F.xxhash64("doc"), F.when(side == 1, nb).otherwise(ns))
    mine = F.when(side == 1, F.transform(F.sequence(F.lit(0).cast("long"), ns - 1), lambda x: F.struct(x.alias("x"), (-1 - h).alias("y")))).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0).cast("long"), ns - 1), lambda x: F.struct(F.least(x, h).alias("x"), F.greatest(x, h).alias("y"))),
            F.transform(F.sequence(F.lit(0).cast("long"), nb - 1), lambda x: F.struct(h.alias("x"), (-1 - x).alias("y"))),
        )
    )
    dealt = rows.join(by, list_).select("*", side.alias("side"), F.explode(mine).alias("at"))
    return dealt.withColumn("key", F.xxhash64(list_, "at.x", "at.y"))


def components(docs: DataFrame, cfg: JaccardConfig = JaccardConfig()) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long"), "text")
    signs = tables.materialise(signed(own, cfg), "op8-signed")
    # an id whose rows have several sets is a node for each; all but the first get numbers beyond every id
    key = F.struct("s1", "s2", "n")
    several = signs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(key).alias("f"), F.max(key).alias("l")).where("f != l")
    several = tables.materialise(several.select(F.col("doc_id").alias("id"), "f"), "op8-repeats")
    noded = _noded(signs, several)
    same = tables.materialise(noded.where("n > 0 AND doc IS NOT NULL").groupBy("s1", "s2", "n").agg(F.min("doc").alias("rep"), F.count("*").alias("c")).where("c > 1"), "op8-classes")
    # very many equal sets are dealt to several tasks
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)).cast("int")
    salted = same.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    member = noded.select("doc_id", "doc", "n", "s1", "s2", salt.alias("salt")).join(salted.hint("merge"), ["s1", "s2", "n", "salt"], "left")
    member = tables.materialise(member.select("doc_id", "doc", "n", F.when(F.col("doc").isNotNull(), F.coalesce("rep", "doc")).alias("rep"), "salt", "c"), "op8-members")
    reps = noded.where("n > 0 AND doc IS NOT NULL").select("doc", "n", "prefix", "sketch").join(member.where("doc != rep").select("doc").hint("merge"), "doc", "left_anti").dropDuplicates(["doc"])
    reps = tables.materialise(reps, "op8-reps")
    tables.drop_tables(spark, signs)
    lists = tables.materialise(_postings(reps), "op8-lists")
    listed = lists.select("doc").distinct()
    sketches = tables.materialise(reps.select("doc", "n", "sketch").join(listed.hint("merge"), "doc", "left_semi"), "op8-sketches")
    tables.drop_tables(spark, reps)
    best = tables.materialise(_pivots(lists, sketches), "op8-best")
    pivoted = tables.materialise(_with_pivots(sketches, best), "op8-pivots")
    tables.drop_tables(spark, best)
    sets = tables.materialise(_sets(own, pivoted.where("piv != doc OR heads IS NOT NULL"), several, cfg), "op8-sets")
    near = tables.materialise(_deltas(sets, cfg), "op8-deltas")
    tables.drop_tables(spark, sets)
    # what a set's distance to its pivot says already
    direct = F.col("piv") != F.col("doc")
    np_ = near.where("piv = doc").select("piv", F.col("n").alias("np"))
    apart = F.length("delta") / 8
    size = F.col("n") + F.col("np")
    links = near.where(direct).select("doc", "n", "piv", apart.alias("apart")).join(np_, "piv").where((100 + cfg.percent) * (size - F.col("apart")) >= 2 * cfg.percent * size).select(F.least("doc", "piv").alias("a"), F.greatest("doc", "piv").alias("b"))
    # sets of one pivot, a block of them at a time
    block = F.pmod(F.xxhash64("doc", F.lit(5)), F.ceil(F.col("rows") / cfg.block))
    local = near.select("*", F.xxhash64("piv", block).alias("key"), F.lit(0).cast("long").alias("pos"), F.col("doc").alias("grp"), F.lit(0).alias("side"))
    several_ids = member.join(several.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "rep").distinct()
    ties = several_ids.join(several_ids.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").where("a != rep").select("a", F.col("rep").alias("b"))
    links = tables.materialise(links.unionByName(ties).unionByName(_meet(local, cfg, within=True)).distinct(), "op8-links")
    groups = connected_components(links)
    # groups of one pivot that fill several blocks
    wide = near.where(F.col("rows") > cfg.block)
    done = [links]
    if not wide.isEmpty():
        rows = wide.join(groups, F.col("doc") == F.col("id"), "left").select(*near.columns, F.coalesce("component", "doc").alias("grp"), F.lit(0).cast("long").alias("pos"))
        more = tables.materialise(_meet(_across(rows, "piv", cfg), cfg, within=True), "op8-links")
        done.append(more)
        tables.drop_tables(spark, groups)
        groups = connected_components(links.unionByName(more))
    tables.drop_tables(spark, near)
    # lists: rows that have a partner of another group and another pivot
    grouped = lists.join(pivoted.select("doc", "piv"), "doc").join(groups, F.col("doc") == F.col("id"), "left").select("tok", "doc", "n", "pos", "piv", F.coalesce("component", "doc").alias("grp"))
    grouped = tables.materialise(grouped, "op8-lists")
    tables.drop_tables(spark, lists)
    kinds = grouped.groupBy("tok", "grp", "piv").agg(F.count("*").alias("c"))
    over = lambda *c: F.sum("c").over(Window.partitionBy("tok", *c))
    open_ = kinds.withColumn("all", over()).withColumn("g", over("grp")).withColumn("v", over("piv")).where("all - g - v + c > 0").select("tok", "grp", "piv")
    rows = tables.materialise(grouped.join(open_, ["tok", "grp", "piv"]), "op8-open")
    tables.drop_tables(spark, grouped)
    rest = tables.materialise(_meet(_across(rows, "tok", cfg).join(sketches.select("doc", "sketch"), "doc"), cfg, within=False), "op8-pairs")
    if not rest.isEmpty():
        asked = rest.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
        sets = tables.materialise(_sets(own, asked, several, cfg), "op8-sets")
        done.append(tables.materialise(_verified(sets, rest, cfg), "op8-links"))
        tables.drop_tables(spark, sets)
        links = done[0]
        for x in done[1:]:
            links = links.unionByName(x)
        tables.drop_tables(spark, groups)
        groups = connected_components(links)
    tables.drop_tables(spark, rows, rest, sketches, pivoted, several, *done)
    # copies take their representative's component, by the same deal as above
    comp = groups.groupBy("id").agg(F.min("component").alias("component"))
    many = same.select("rep", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    copies = comp.join(many, F.col("id") == F.col("rep")).select("rep", "salt", "component")
    plain = member.where("c IS NULL").join(comp, F.col("rep") == F.col("id"), "left").select("doc_id", "n", "rep", "component")
    salted = member.where("c IS NOT NULL").join(copies.hint("merge"), ["rep", "salt"], "left").select("doc_id", "n", "rep", "component")
    return plain.unionByName(salted).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
