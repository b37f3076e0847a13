"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are 64-bit hashes of single words, neighbouring pairs, pairs with one
word between, and triples (A-Z folded, words are runs of letters, digits and
bytes above 127). A feature counts once in a document. Training keeps per
coordinate the FTRL state (z, n): the learning rate falls with a coordinate's
own gradients, and L1 leaves most weights exactly zero, so the model is some
thousand (hash, weight) pairs, whatever the corpus.

Defined results: null and empty texts score the model's bias; a missing label
never trains; several labels of one document count as toxic if any is; with no labels of one kind the score is the share of toxic labels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernels as K

U64 = K.U64
_WORD = np.ones(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_lo:_hi] = False  # False: part of a word, as for kernels.SPACE


@dataclass(frozen=True)
class FtrlConfig:
    max_rows: int = 8000  #: labelled documents that training reads at most, an even sample by hash of the id
    min_df: int = 3  #: training documents that a feature must occur in
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.0
    epochs: int = 10


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document index, feature hash) for every n-gram and skip-gram of a chunk."""
    s, e, wptr = K.word_spans(data, off, _WORD)
    if not len(s):
        return np.zeros(0, np.int32), np.zeros(0, U64)
    w = K.spans(K.prefix(K.FOLDED[data]), s, e)
    doc = K.owners(wptr).astype(np.int32)
    docs, feats = [doc], [w]
    for tag, gap in ((1, 1), (2, 2)):
        if len(w) > gap:
            same = doc[gap:] == doc[:-gap]
            feats.append(K.mix(w[:-gap] * U64(3) + w[gap:] * U64(5) + U64(tag))[same])
            docs.append(doc[gap:][same])
    if len(w) > 2:
        same = doc[2:] == doc[:-2]
        feats.append(K.mix(w[:-2] * U64(3) + w[1:-1] * U64(5) + w[2:] * U64(7) + U64(3))[same])
        docs.append(doc[2:][same])
    return np.concatenate(docs), np.concatenate(feats)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, n_features: int, cfg: FtrlConfig) -> tuple[np.ndarray, float]:
    """Weights and bias after some passes over (feature indexes, label) rows in a fixed order."""
    z, n = np.zeros(n_features + 1), np.zeros(n_features + 1)
    order = np.random.default_rng(7).permutation(len(rows))

    def weights(i):
        zi, ni = z[i], n[i]
        w = -(zi - np.sign(zi) * cfg.l1) / ((cfg.beta + np.sqrt(ni)) / cfg.alpha + cfg.l2)
        w[np.abs(zi) <= cfg.l1] = 0.0
        return w

    for _ in range(cfg.epochs):
        for r in order:
            i = np.append(rows[r], n_features)
            w = weights(i)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - labels[r]
            old = n[i]
            new = old + g * g
            z[i] += g - (np.sqrt(new) - np.sqrt(old)) / cfg.alpha * w
            n[i] = new
    w = weights(np.arange(n_features + 1))
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, cfg: FtrlConfig = FtrlConfig()) -> tuple[np.ndarray, np.ndarray, float]:
    """(sorted feature hashes, weights, bias) from documents joined with labels on doc_id.

    ``labels`` has doc_id and toxic; training takes an even sample of at most
    about ``cfg.max_rows`` rows, so one task can hold it.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    if not total:
        return np.zeros(0, U64), np.zeros(0), 0.0
    # the sampled labels are bounded by max_rows, so their broadcast is as well
    share = min(1.0, cfg.max_rows * 0.95 / total)
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def train(batches):
        doc_ids, ys, f = [], [], []
        for b, data, off in K.chunks(batches):
            d, h = features(data, off)
            cut = np.searchsorted(d[np.argsort(d, kind="stable")], np.arange(len(off)))
            h = h[np.argsort(d, kind="stable")]
            f += [np.unique(h[cut[i] : cut[i + 1]]) for i in range(len(off) - 1)]
            doc_ids.append(K.ids_column(b))
            ys.append(b.column(b.schema.get_field_index("toxic")).cast(pa.int64()).to_numpy(zero_copy_only=False))
        if not f:
            return
        order = np.argsort(np.concatenate(doc_ids), kind="stable")
        y = np.concatenate(ys)[order].astype(float)
        every, df = np.unique(np.concatenate(f), return_counts=True)
        every = every[df >= cfg.min_df]
        kept = []
        for i in order:
            at = np.searchsorted(every, f[i])
            at[at == len(every)] = 0
            kept.append(at[every[at] == f[i]] if len(every) else at[:0])
        if y.min() == y.max():
            w, bias = np.zeros(len(every)), 35.0 * (2 * y[0] - 1)
        else:
            w, bias = ftrl(kept, y, len(every), cfg)
        on = w != 0
        yield pa.RecordBatch.from_arrays([K.blobs([every[on]]), K.blobs([w[on]]), pa.array([bias])], ["h", "w", "bias"])

    got = rows.repartition(1).mapInArrow(train, "h binary, w binary, bias double").collect()
    if not got:
        return np.zeros(0, U64), np.zeros(0), 0.0
    return np.frombuffer(got[0].h, U64), np.frombuffer(got[0].w, np.float64), got[0].bias


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id, score: the model's probability for every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        keys, w, bias = sent.value
        maybe = np.zeros(1 << 20, bool)
        maybe[(keys >> U64(44)).astype(np.int64)] = True
        for b, data, off in K.chunks(batches):
            total = np.full(len(off) - 1, bias)
            if len(keys):
                d, h = features(data, off)
                few = maybe[(h >> U64(44)).astype(np.int64)]
                d, h = d[few], h[few]
                at = np.searchsorted(keys, h)
                at[at == len(keys)] = 0
                hit = keys[at] == h
                once = np.unique(d[hit].astype(np.int64) * len(keys) + at[hit])
                np.add.at(total, once // len(keys), w[once % len(keys)])
            p = 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")).cast(pa.int64()), pa.array(p)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
