"""SentencePiece encoding and decoding by merge rounds over flat arrays.

Texts are cut into words where no piece of the vocabulary reaches across: before a run of spaces. A batch's words that no cache
has yet become one flat array of symbols, a word a segment. A round finds the rank of every neighbouring pair, the
least rank of each word, and merges all places with that rank at once, the leftmost first where they overlap. Words without a
pair that can merge leave the array; the rest is compacted, until none remains. A merge that brings up a pair as good
as its own or better ends the word's round there, since one queue for the text would take that pair before the next place. Symbols that are no piece
become bytes. Decoding puts the pieces' bytes in a row, spaces for the mark, and takes off the space that encoding put in front.

The rules are read from the model file: BPE, text taken as it is, one space in front, spaces kept, bytes for what is not in the
vocabulary. A model of another kind is refused. Null and empty texts are the end id alone and decode to the empty text. A text of any length is
encoded whole. Repeated rows and ties make no difference; extra columns are kept, those named like a result are replaced; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TwoGenerations, add_columns

#: The mark that stands for a space in pieces.
MARK = "▁"
#: Kinds of pieces in a model file (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Characters of a batch that are encoded at a time, and of the longest word that a cache keeps.
SLICE_CHARS, KEPT_CHARS = 2_000_000, 48
NONE = np.iinfo(np.int64).max
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a message in the wire format of model files."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while at < len(message):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or number()
        yield tag >> 3, message[at : at + size]
        at += size


class Vocabulary:
    """What a model file says: pieces with their kinds, ranks of pairs, bytes of every id."""

    def __init__(self, model_file: str):
        with open(model_file, "rb") as f:
            model = list(_fields(f.read()))
        trainer, normal = (dict(_fields(next((v for k, v in model if k == n), b""))) for n in (2, 3))
        pieces = [dict(_fields(v)) for k, v in model if k == 1]
        text = [p[1].decode() for p in pieces]
        kind = [p.get(3, NORMAL) for p in pieces]
        score = [struct.unpack("<f", p[2])[0] if 2 in p else 0.0 for p in pieces]
        plain = normal.get(2, b"") == b"" and normal.get(3, 1) and not normal.get(4, 1) and normal.get(5, 1)
        if trainer.get(3, 1) != 2 or not plain or trainer.get(24, 0) or kind.count(BYTE) != 256 or {USER_DEFINED, UNUSED} & set(kind):
            raise ValueError("not a byte-fallback BPE model that takes texts as they are")
        usable = [i for i, k in enumerate(kind) if k == NORMAL]
        if any(MARK in text[i].lstrip(MARK) for i in usable):
            raise ValueError("a piece of this vocabulary crosses words")
        self.end = trainer.get(42, 2)
        byte_of = {i: int(text[i][3:5], 16) for i, k in enumerate(kind) if k == BYTE}
        self.byte_ids = np.zeros(256, np.int64)
        for i, b in byte_of.items():
            self.byte_ids[b] = i
        self.bytes = [bytes([byte_of[i]]) if k == BYTE else b"" if k == CONTROL else t.replace(MARK, " ").encode() for i, (t, k) in enumerate(zip(text, kind))]
        # symbols are numbered like the pieces; characters inside of pieces that are none themselves come after them
        symbol = {text[i]: i for i in usable}
        for c in sorted({c for i in usable for c in text[i]} - symbol.keys()):
            symbol[c] = len(text) + len(symbol) - len(usable)
        self.symbols, self.n_pieces = len(text) + len(symbol) - len(usable), len(text)
        chars = sorted(c for c in symbol if len(c) == 1)
        self.extra = {i: c for c, i in symbol.items() if i >= len(text)}
        self.of_char = -1 - np.arange(0x110000, dtype=np.int64)  # below 0: a character of no piece
        for c, i in symbol.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
        rank = {s: r for r, s in enumerate(sorted({score[i] for i in usable}, reverse=True))}
        pairs = sorted((symbol[t[:cut]] * self.symbols + symbol[t[cut:]], rank[score[i]], i) for i in usable for t in [text[i]] for cut in range(1, len(t)) if t[:cut] in symbol and t[cut:] in symbol)
        self.pair_keys, self.pair_ranks, self.pair_pieces = (np.array(column, np.int64) for column in zip(*pairs))

    def found(self, left: np.ndarray, right: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE: no piece) and piece of the pairs."""
        keys = np.where(valid & (left >= 0) & (right >= 0), left * self.symbols + right, -1)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE), self.pair_pieces[at]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words (none empty), one after the other, and where each begins; the mark stands for spaces."""
        lengths = np.array([len(w) for w in words], np.int64)
        sym = self.of_char[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        word = np.repeat(np.arange(len(words)), lengths)
        rank, piece = self.found(sym[:-1], sym[1:], word[1:] == word[:-1])
        state = sym, word, np.r_[rank, NONE], np.r_[piece, 0]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(state[0]):
            state = self._round(*state, done)
        sym, word = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        sym, word = self._as_bytes(sym[order], word[order])
        return sym.astype(np.int32), np.r_[0, np.cumsum(np.bincount(word, minlength=len(words)))]

    def _round(self, sym: np.ndarray, word: np.ndarray, rank: np.ndarray, piece: np.ndarray, done: list) -> tuple[np.ndarray, ...]:
        """The arrays after one round; rank and piece are those of each symbol with the next one of its word."""
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        sizes = np.diff(np.r_[starts, len(word)])
        least = np.minimum.reduceat(rank, starts)
        if (least == NONE).any():
            over = np.repeat(least == NONE, sizes)
            done.append((sym[over], word[over]))
            sym, word, rank, piece = sym[~over], word[~over], rank[~over], piece[~over]
            least, sizes = least[least != NONE], sizes[least != NONE]
            if not len(sym):
                return sym, word, rank, piece
        at = np.flatnonzero(rank == np.repeat(least, sizes))
        # of places that overlap in a row the first, third, ... merge; a word's last symbol begins no pair, so rows end with it
        number = np.arange(len(at))
        row = np.maximum.accumulate(np.where(np.r_[True, at[1:] != at[:-1] + 1], number, 0))
        at = at[(number - row) % 2 == 0]
        merged, goal = piece[at], rank[at]
        # the pairs that a merge brings up: with what stands to the left by then, and to the right still
        joined = np.r_[False, at[1:] == at[:-1] + 2]
        before = np.where(joined, np.r_[-1, merged[:-1]], sym[at - 1])
        after = np.minimum(at + 2, len(sym) - 1)
        up = np.minimum(self.found(before, merged, (at > 0) & (word[at - 1] == word[at]))[0], self.found(merged, sym[after], (at + 2 < len(sym)) & (word[after] == word[at]))[0])
        if (stops := up <= goal).any():  # places of the same word behind a stop wait for the next round
            owner = word[at]
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            first = np.minimum.reduceat(np.where(stops, at, NONE), heads)
            going = at <= np.repeat(first, np.diff(np.r_[heads, len(at)]))
            at, merged = at[going], merged[going]
        sym[at] = merged
        kept = np.ones(len(sym), bool)
        kept[at + 1] = False
        sym, word, rank, piece = sym[kept], word[kept], rank[kept], piece[kept]
        at -= np.arange(len(at))  # where the merged symbols are now
        near = np.zeros(len(sym), bool)
        near[at] = near[at[at > 0] - 1] = True
        anew = np.flatnonzero(near)
        after = np.minimum(anew + 1, len(sym) - 1)
        rank[anew], piece[anew] = self.found(sym[anew], sym[after], (anew + 1 < len(sym)) & (word[after] == word[anew]))
        return sym, word, rank, piece

    def _as_bytes(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no piece become the ids of their bytes."""
        odd = np.flatnonzero((sym < 0) | (sym >= self.n_pieces))
        if not len(odd):
            return sym, word
        each = [self.byte_ids[list((self.extra[s] if s >= 0 else chr(-1 - s)).encode())] for s in sym[odd].tolist()]
        counts = np.ones(len(sym), np.int64)
        counts[odd] = [len(x) for x in each]
        out = np.repeat(sym, counts)
        first = np.cumsum(counts) - counts
        out[np.concatenate([np.arange(f, f + len(x)) for f, x in zip(first[odd].tolist(), each)])] = np.concatenate(each)
        return out, np.repeat(word, counts)


class Codec:
    """Encodes and decodes texts with a bounded cache of words."""

    def __init__(self, model_file: str, cache: int = 200_000):
        self.vocabulary, self.cache = Vocabulary(model_file), TwoGenerations(cache)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text with the end id behind them."""
        cut = [WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        known = {w: self.cache.get(w) for w in dict.fromkeys(chain.from_iterable(cut))}
        if fresh := [w for w, ids in known.items() if ids is None]:
            ids, starts = self.vocabulary.encode_words(fresh)
            raw, starts = ids.tobytes(), (starts * 4).tolist()
            for w, lo, hi in zip(fresh, starts, starts[1:]):
                known[w] = found = raw[lo:hi]
                if len(w) <= KEPT_CHARS:
                    self.cache.put(w, found)
        end = np.int32(self.vocabulary.end).tobytes()
        return [np.frombuffer(b"".join(map(known.__getitem__, words)) + end, np.int32) for words in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become the replacement character."""
        raw = b"".join(map(self.vocabulary.bytes.__getitem__, ids.tolist()))
        return raw.removeprefix(b" ").decode(errors="replace")


_LOADED: dict[str, Codec] = {}


def encode_decode(df: DataFrame, model_file: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ids (array<int>, the end id last) and decoded (the text that they decode to) to the columns ``keep`` (None: all)."""

    def make():
        codec = _LOADED.setdefault(model_file, None) or Codec(model_file)
        _LOADED[model_file] = codec

        def each(texts: list) -> list[pa.Array]:
            ids, decoded, lo, size = [], [], 0, 0
            for hi, t in enumerate(texts, 1):
                size += len(t or "")
                if size >= SLICE_CHARS or hi == len(texts):
                    ids += codec.encode(texts[lo:hi])
                    lo, size = hi, 0
            decoded = [codec.decode(x) for x in ids]
            offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
            return [pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(decoded, pa.string())]

        return each

    return add_columns(df, text_col, keep, "ids array<int>, decoded string", make)


def codec_report(df: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    done = encode_decode(df, model_file, keep=["doc_id"])
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
