"""Token ids of whole texts by an existing tokenizer of the tokenizers library, each distinct word encoded once.

The tokenizer of ``word_bpe_49k.json`` lower-cases, drops white space and merges
within runs of letters or of marks, so the ids of a text are those of its pieces
in order, where pieces end at white space and between an ASCII letter or digit
and an ASCII mark (not at apostrophes, which make contractions, nor at < | >,
which special tokens hold). A worker process keeps the pieces it has met, compared byte by byte, with their ids in
one flat array, over its tasks, and starts anew when ``LIMIT`` pieces or ``ROOM`` bytes of them are held, so its memory is bounded.
"""

from __future__ import annotations

import os
import zlib

import numpy as np

from . import kernels as K

U64 = K.U64
#: Pieces that a worker holds at most, and bytes of them.
LIMIT, ROOM = 700_000, 64 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_MARK, _ALNUM = np.zeros(256, bool), np.zeros(256, bool)
_MARK[[ord(c) for c in "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"]] = True
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_pieces(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, offsets by document) of pieces, A-Z lower-cased unless a special token might be spelled."""
    s, e, _ = K.word_spans(data, off)
    if not ((data[:-1] == 60) & (data[1:] == 124)).any():
        data = _LOWER[data]
    mark, alnum = _MARK[data], _ALNUM[data]
    cut = np.flatnonzero((mark[:-1] & alnum[1:]) | (alnum[:-1] & mark[1:])) + 1
    # a cut at a document's edge is a word's start already
    cut = cut[~np.isin(cut, off, assume_unique=False)] if len(cut) else cut
    s, e = np.sort(np.concatenate([s, cut])), np.sort(np.concatenate([e, cut]))
    return data, s, e, np.searchsorted(s, off)


class PieceEncoder:
    """``encode(pieces) -> list of id lists`` made to work on chunks; holds what it has met."""

    def __init__(self, encode) -> None:
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.known = K.Vocabulary()
        self.start, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def fresh(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of spans not met before, one after the other, and how many each has)."""
        raw = data.tobytes()
        got = self.encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(s.tolist(), e.tolist())])
        n = np.array([len(x) for x in got], np.int64)
        return np.fromiter((i for x in got for i in x), np.uint32, int(n.sum())), n

    def slots(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """For each span the number of its entry in start and size; encodes what is new."""
        if self.known.count > LIMIT or self.known.bytes > ROOM:
            self.clear()
        out, new = self.known.numbers(data, s, e)
        if len(new):
            flat, n = self.fresh(data, s[new], e[new])
            self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(n) - n])
            self.size, self.pool = np.concatenate([self.size, n]), np.concatenate([self.pool, flat])
        return out

    def ids(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by document) of a chunk of texts."""
        data, s, e, ptr = lower_pieces(data, off)
        if not len(s):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        slot = self.slots(data, s, e)
        n = self.size[slot]
        return self.pool[K.ranges(self.start[slot], n)], np.concatenate([[0], np.cumsum(n)])[ptr]


#: The encoder that this worker process used last, by tokenizer file: what a task has met, the next one need not encode.
_last: dict[tuple, PieceEncoder] = {}


def word_encoder(path: str) -> PieceEncoder:
    """The encoder of a tokenizer file, kept for the tasks that follow in the same process; ``LIMIT`` and ``ROOM`` bound it there too."""
    about = os.stat(path)
    key = (path, about.st_mtime_ns, about.st_size)
    if key not in _last:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        _last.clear()
        _last[key] = PieceEncoder(lambda pieces: [x.ids for x in tok.encode_batch_fast(pieces, add_special_tokens=False)])
    return _last[key]


def with_end(ids: np.ndarray, ptr: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with one end id after each document."""
    n = np.diff(ptr)
    at = ptr + np.arange(len(ptr))
    out = np.full(len(ids) + len(n), end, np.uint32)
    out[K.ranges(at[:-1], n)] = ids
    return out, at


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").view(np.uint8)) & 0xFFFFFFFF
