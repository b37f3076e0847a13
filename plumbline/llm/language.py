"""Language identification of mixed-language text: script ranges, then Viterbi over word scores.

A word (run without white space) has a score for each language: the naive-Bayes
log-likelihoods of its three-byte grams and, for words met in training, of the
word itself. Languages that are never written in the word's script drop out
before. Viterbi finds the best labelling of a document's words where a change of
language costs ``switch``; equal neighbours form spans.

Defined results: ``und`` and score 0 for null texts and texts without a letter;
otherwise the language that labels most letters, ties to the first in
alphabetical order, with its share of the letters as score; very long texts are labelled whole; repeated rows are
labelled alike, null ids too; an empty table gives no rows. With no training
rows every text is ``und``. ``predict`` reads doc_id and text only, ``annotate`` keeps all columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import kernels as K

U64 = K.U64
GRAMS, WORDS = 1 << 16, 1 << 18

#: First code points of Unicode block groups, and the script each group belongs to.
_SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1400, "Other"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"),
    (0xA000, "Other"), (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"), (0x30000, "Other"),
)
_STARTS = np.array([a for a, _ in _SCRIPTS])
SCRIPT_NAMES = ["none", *dict.fromkeys(b for _, b in _SCRIPTS)]
_SCRIPT_OF = np.array([SCRIPT_NAMES.index(b) for _, b in _SCRIPTS], np.uint8)
_letters: list[np.ndarray] = []


@dataclass(frozen=True)
class LanguageConfig:
    max_rows: int = 4000  #: labelled documents that training reads at most, an even sample by hash of the id
    switch: float = 9.0  #: cost of a change of language between two words
    floor: float = -12.0  #: the least score of a word against its best language
    min_share: float = 0.01  #: share of a language's words in a script from which the language may be written in it


def letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of letters' first bytes, script number of each)."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    ascii_at = np.zeros(256, bool)
    ascii_at[65:91] = ascii_at[97:123] = True
    plain = np.flatnonzero(ascii_at[data])
    lead = np.flatnonzero(data >= 0xC2)
    if not len(lead):
        return plain, np.ones(len(plain), np.uint8)
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    b = [padded[lead + i].astype(np.int64) for i in range(4)]
    two, three = b[0] < 0xE0, (b[0] >= 0xE0) & (b[0] < 0xF0)
    cp = np.where(two, (b[0] & 31) << 6 | b[1] & 63, np.where(three, (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63, (b[0] & 7) << 18 | (b[1] & 63) << 12 | (b[2] & 63) << 6 | b[3] & 63))
    cp = np.minimum(cp, 0x10FFFF)
    ok = _letters[0][cp]
    at, script = lead[ok], _SCRIPT_OF[np.searchsorted(_STARTS, cp[ok], "right") - 1]
    every = np.concatenate([plain, at])
    order = np.argsort(every, kind="stable")
    return every[order], np.concatenate([np.ones(len(plain), np.uint8), script])[order]


def gram_ids(data: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """For each byte the bucket of the gram (byte before, byte, byte after), with A-Z folded and white space as one mark."""
    low = data.copy()
    up = (low >= 65) & (low <= 90)
    low[up] += 32
    low[~inside] = 0
    x = np.zeros(len(low) + 2, np.uint32)
    x[1:-1] = low
    h = x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(16)).astype(np.int32)


def _look(data, off):
    """Words, their grams, letters and scripts of a chunk."""
    s, e, wptr = K.word_spans(data, off)
    inside = ~K.SPACE[data]
    grams = gram_ids(data, inside)
    w = (K.spans(K.prefix(K.FOLDED[data]), s, e) >> U64(46)).astype(np.int64)
    at, script = letters(data)
    of = np.searchsorted(s, at, "right") - 1
    n_letters = np.bincount(of, minlength=len(s)) if len(s) else np.zeros(0, np.int64)
    top = np.zeros(len(s), np.uint8)
    np.maximum.at(top, of, script)
    return s, e, wptr, grams, w, n_letters, top


def fit(docs: DataFrame, cfg: LanguageConfig = LanguageConfig()) -> dict:
    """Log-likelihood tables from the texts and non-null ``lang`` of ``docs`` (doc_id, text, lang)."""
    spark = docs.sparkSession
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    total = known.count()
    share = min(1.0, cfg.max_rows * 0.95 / max(total, 1))
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def count(batches):
        sums: dict = {}
        for b, data, off in K.chunks(batches):
            s, e, wptr, grams, w, n_letters, top = _look(data, off)
            names = b.column(b.schema.get_field_index("lang")).to_pylist()
            g_at = np.searchsorted(off, s, "right") - 1
            for name in set(names):
                mine = np.array([x == name for x in names])[g_at] if len(s) else np.zeros(0, bool)
                mine &= n_letters > 0
                g, ws, sc = sums.setdefault(name, (np.zeros(GRAMS, np.int64), np.zeros(WORDS, np.int64), np.zeros(len(SCRIPT_NAMES), np.int64)))
                pos = K.ranges(s[mine], (e - s)[mine])
                g += np.bincount(grams[pos], minlength=GRAMS)
                ws += np.bincount(w[mine], minlength=WORDS)
                sc += np.bincount(top[mine], minlength=len(SCRIPT_NAMES))
        if sums:
            # counts that are not 0, as (place, count) pairs
            packed = [[np.stack([np.flatnonzero(x), x[np.flatnonzero(x)]]).astype(np.int32) for x in v] for v in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), *(K.blobs([v[i] for v in packed]) for i in range(3))], ["lang", "g", "w", "s"])

    # a fixed number of tasks, so that the tables sent to the driver are bounded as well
    parts = picked.repartition(4).mapInArrow(count, "lang string, g binary, w binary, s binary").collect()
    names = sorted({p.lang for p in parts})
    g, w, s = (np.zeros((len(names), n)) for n in (GRAMS, WORDS, len(SCRIPT_NAMES)))
    for p in parts:
        i = names.index(p.lang)
        for table, blob in ((g, p.g), (w, p.w), (s, p.s)):
            at, count = np.frombuffer(blob, np.int32).reshape(2, -1)
            table[i, at] += count
    if not names:
        return {"names": [], "cfg": cfg}
    lg = np.log((g + 0.5) / (g.sum(1, keepdims=True) + 0.5 * GRAMS))
    lw = np.log((w + 0.2) / (w.sum(1, keepdims=True) + 0.2 * WORDS))
    lw[:, w.sum(0) < 3] = 0.0  # words hardly met say nothing of their own
    return {"names": names, "cfg": cfg, "grams": np.ascontiguousarray((lg - lg.max(0)).T, np.float32), "words": np.ascontiguousarray((lw - lw.max(0)).T, np.float32), "scripts": (s >= np.maximum(1, cfg.min_share * s.sum(1, keepdims=True))).T.copy()}


def emissions(model: dict, s, e, grams, w, n_letters, top) -> np.ndarray:
    """Scores of words (rows) in languages (columns), 0 for the best."""
    if not len(s):
        return np.zeros((0, len(model["names"])), np.float32)
    edges = np.empty(2 * len(s), np.int64)
    edges[0::2], edges[1::2] = s, e
    last = edges[-1] >= len(grams)
    out = np.empty((len(s), len(model["names"])), np.float32)
    for k in range(out.shape[1]):
        table = np.ascontiguousarray(model["grams"][:, k])
        out[:, k] = np.add.reduceat(table[grams], edges[:-1] if last else edges)[0::2]
    out *= 0.5
    out += model["words"][w]
    can = model["scripts"][top]
    some = can.any(1)
    out[~can & some[:, None]] = -1e3
    out -= out.max(1, keepdims=True)
    np.maximum(out, model["cfg"].floor, out=out)
    out[~can & some[:, None]] = 2 * model["cfg"].floor
    out[n_letters == 0] = 0.0
    return out


def viterbi(scores: np.ndarray, wptr: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word, all documents in step; a document's labels depend on its own words only."""
    n, k = scores.shape
    label = np.zeros(n, np.uint8)
    size = np.diff(wptr)
    order = np.argsort(-size, kind="stable")
    size, first = size[order], wptr[:-1][order]
    if not n:
        return label
    from_best = np.zeros((n, k), bool)
    best_prev = np.zeros(n, np.uint8)
    live = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right")
    delta = scores[first[: live[0]]].astype(np.float64)
    ends = np.zeros((len(size), k))
    ends[: live[0]] = delta
    for t in range(1, len(live)):
        m = live[t]
        at = first[:m] + t
        delta = delta[:m]
        best = delta.argmax(1)
        jump = delta[np.arange(m), best] - switch
        go = delta < jump[:, None]
        from_best[at], best_prev[at] = go, best
        delta = np.where(go, jump[:, None], delta) + scores[at]
        delta -= delta.max(1, keepdims=True)
        ends[:m] = delta
    state = ends.argmax(1)
    for t in range(len(live) - 1, -1, -1):
        m = live[t]
        at = first[:m] + t
        label[at] = state[:m]
        if t:
            go = from_best[at, state[:m]]
            state[:m] = np.where(go, best_prev[at], state[:m])
    return label


_OUT = "doc_id long, lang_pred string, score double, n_spans int, spans array<struct<lang:string,start:int,stop:int>>"


def _label(data: np.ndarray, off: np.ndarray, model: dict, spans: bool):
    """(languages, scores, numbers of spans, spans) of a chunk's documents."""
    names, n = model["names"], len(off) - 1
    pred, sure, n_spans = np.full(n, "und", object), np.zeros(n), np.zeros(n, np.int32)
    made = [[] for _ in range(n)] if spans else None
    if names and len(data):
        s, e, wptr, grams, w, n_letters, top = _look(data, off)
        label = viterbi(emissions(model, s, e, grams, w, n_letters, top), wptr, model["cfg"].switch)
        doc = K.owners(wptr)
        by = np.bincount(doc * len(names) + label, weights=n_letters, minlength=n * len(names)).reshape(n, -1)
        total = by.sum(1)
        some = total > 0
        pred[some] = np.array(names, object)[by.argmax(1)[some]]
        sure[some] = by.max(1)[some] / total[some]
        if len(s):
            head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])]))
            tail = np.append(head[1:], len(label))
            n_spans += np.bincount(doc[head], minlength=n).astype(np.int32)
            if spans:
                for d, k, i, j in zip(doc[head].tolist(), label[head].tolist(), (head - wptr[doc[head]]).tolist(), (tail - wptr[doc[head]]).tolist()):
                    made[d].append({"lang": names[k], "start": i, "stop": j})
    return pred, sure, n_spans, made


def predict(docs: DataFrame, model: dict, spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score, n_spans, spans (word ranges [start, stop) of one language) for every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches):
        for b, data, off in K.chunks(batches):
            pred, sure, n_spans, made = _label(data, off, sent.value, spans)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")).cast(pa.int64()), pa.array(pred, pa.string()), pa.array(sure), pa.array(n_spans, pa.int32()), pa.array(made if spans else [None] * len(pred), kind)], ["doc_id", "lang_pred", "score", "n_spans", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _OUT)


def annotate(docs: DataFrame, model: dict, lang: str = "__lang_pred", score: str = "__lang_score") -> DataFrame:
    """``docs`` with all columns, and each text's language and score beside them, in one pass without a join."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    shape = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches):
        for b, data, off in K.chunks(batches):
            pred, sure, *_ = _label(data, off, sent.value, False)
            yield b.append_column(lang, pa.array(pred, pa.string())).append_column(score, pa.array(sure))

    return docs.mapInArrow(run, shape)
