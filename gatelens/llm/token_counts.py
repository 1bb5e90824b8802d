"""Token counts without a shuffle of pre-tokens: a broadcast table of frequent pre-token lengths, then worker caches.

A sentencepiece BPE vocabulary in which no piece has a space after another character, or a line feed, never merges
across the start of a run of spaces nor next to a line feed. So a text's count is the sum over its pre-tokens, each a
run of spaces with what follows up to the next space or line feed. The driver encodes the frequent ones once and broadcasts
their lengths, so a task looks them up; what the table lacks is encoded once a worker's cache. Both properties are read from the vocabulary
when it is loaded; a vocabulary without them is refused.

Nulls and empty texts have 0 tokens. A text of any length is counted whole; long pre-tokens are encoded, not kept.
Ties, repeated rows and extra columns make no difference: each row is counted on its own and every column is kept
but for those named like a result, which are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import TwoGenerations, add_columns, frequent_pieces

#: Longest pre-token, in characters, that a cache keeps.
KEPT_CHARS = 48


def pre_tokens(text: str) -> list[str]:
    """Cut at spaces; a line feed starts a piece of its own. Empty pieces stand for runs of spaces."""
    return text.replace("▁", " ").replace("\n", " \n").split(" ")


class PieceLengths(dict):
    """Pre-token -> number of tokens. The dict itself is the broadcast tier and never grows; misses, runs of spaces with what
    follows them among them, go to the cache."""

    def __init__(self, model_file: str, frequent: dict[str, int] | None = None, cache: int = 200_000):
        import sentencepiece

        super().__init__(frequent or {})
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
            raise ValueError("a piece of this vocabulary crosses pre-tokens")
        self.cache = TwoGenerations(cache)

    def encoded(self, piece: str) -> int:
        n = len(self.model.encode(piece))
        return n - 1 if piece[:1] == "\n" else n  # the model puts a space before the line feed, the text has none

    def __missing__(self, piece: str) -> int:
        if (n := self.cache.get(piece)) is None:
            n = self.encoded(piece)
            if len(piece) <= KEPT_CHARS:
                self.cache.put(piece, n)
        return n

    def spaces(self, k: int) -> int:
        """Tokens of k spaces with nothing after them in their pre-token; the model adds one space itself."""
        return 0 if k == 0 else 1 if k == 1 else self[" " * (k - 1)]

    def count(self, text: str) -> int:
        if not text:
            return 0
        pieces = pre_tokens(text)
        if "" not in pieces:
            return sum(map(self.__getitem__, pieces))
        total, blank = 0, 0
        for piece in pieces:  # each piece has one space before it, each empty one before it one more
            if piece == "":
                blank += 1
            elif piece[0] == "\n":  # the space before it was put there by pre_tokens
                total, blank = total + self.spaces(blank) + self[piece], 0
            elif blank:
                total, blank = total + self[" " * blank + piece], 0
            else:
                total += self[piece]
        return total + self.spaces(blank)


def token_counts(df: DataFrame, model_file: str, text_col: str = "text", keep: list[str] | None = None, limit: int = 4096, frequent: int = 16_384) -> DataFrame:
    """Adds n_bytes, n_tokens (long) and over_limit (boolean: n_tokens > limit) to the columns ``keep`` (None: all).

    frequent: entries of the broadcast table of lengths, each at most 32 bytes long; so its size does not grow with the data."""
    top = [p.decode() for p in frequent_pieces(df, text_col, pre_tokens, frequent)]
    model = PieceLengths(model_file)
    shared, query = df.sparkSession.sparkContext.broadcast({p: model.encoded(p) for p in top}), uuid.uuid4().hex

    def make():
        lengths = _loaded(model_file, query, shared)

        def each(texts: list) -> list[pa.Array]:
            n = [lengths.count(t) if t else 0 for t in texts]
            size = [len(t.encode()) if t else 0 for t in texts]
            return [pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]

        return each

    return add_columns(df, text_col, keep, "n_bytes bigint, n_tokens bigint, over_limit boolean", make)


_LOADED: dict = {}


def _loaded(model_file: str, query: str, shared) -> PieceLengths:
    """A worker loads a model and its tables once, for all tasks of the same query."""
    key = (model_file, query)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PieceLengths(model_file, shared.value)
    return _LOADED[key]
