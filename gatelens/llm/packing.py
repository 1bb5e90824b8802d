"""Best-fit packing of tokenised documents into sequences, certified and repaired by lower bounds.

Documents become pieces of at most ``capacity`` tokens (only longer documents are cut). Pieces are dealt to groups
of bounded size; each group is packed by best-fit decreasing and gets a lower bound of its bin count from dual
feasible functions. Groups whose bound is met are certified. The others keep their full bins, give up the pieces of all
other bins, exchange them, and are packed and certified again; a rerun is taken only if it needs fewer bins. As the groups'
bounds may add up to more than the bound over all pieces, the emptiest bins of all groups then meet in the same way.

A null text is empty and still has its closing id. Texts of any length are tokenised whole. Equal lengths are taken in
the order of (doc_id, piece). Repeated rows are packed as often as they occur. Extra columns are not
carried into the pieces, so their names cannot clash. An empty table gives no sequences.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TwoGenerations, written

#: A word of plain letters, then marks that are neither letters, digits, blanks nor apostrophes: two pre-tokens.
PLAIN = re.compile("([A-Za-zß-öø-ÿÀ-ÖØ-Þ]+)([-,.;:!?#*$%&|()\"]*)")


def byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds:
    """Little-endian 32-bit ids of blank-separated words, exactly as the tokenizer gives them for the whole text.

    The tokenizer drops white space and never joins over it, so a text's ids are those of its parts between blanks.
    Words of plain letters with trailing marks go to the vocabulary's own model; all others through the tokenizer."""

    def __init__(self, tokenizer_file: str, cache: int = 200_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.words, self.cores, self.marks = TwoGenerations(cache), TwoGenerations(cache), {}
        self.letters = byte_letters()

    def model_ids(self, pre_token: str) -> bytes:
        spelled = pre_token if pre_token.isascii() else "".join(map(self.letters.__getitem__, pre_token.encode()))
        return np.array([x.id for x in self.tokenizer.model.tokenize(spelled)], "<u4").tobytes()

    def encoded(self, word: str) -> bytes:
        if plain := PLAIN.fullmatch(word):
            core, mark = plain[1].lower(), plain[2]
            if (ids := self.cores.get(core)) is None:
                ids = self.model_ids(core)
                self.cores.put(core, ids)
            if mark:
                if len(self.marks) > 10_000:
                    self.marks.clear()
                if mark not in self.marks:
                    self.marks[mark] = self.model_ids(mark)
                ids += self.marks[mark]
            return ids
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def text(self, text: str) -> bytes:
        parts = text.replace("\n", " ").split(" ")
        young, out = self.words.young, []
        for word in parts:
            ids = young.get(word)
            if ids is None:
                if not word:
                    continue
                ids = self.words.get(word)
                if ids is None:
                    ids = self.encoded(word)
                    if len(word) <= 48:
                        self.words.put(word, ids)
                young = self.words.young
            out.append(ids)
        return b"".join(out)


_LOADED: dict[str, WordIds] = {}


def document_pieces(df: DataFrame, tokenizer_file: str, capacity: int, end_id: int = 0, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, piece int, start long, length long, ids_crc32 long for each piece of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_file not in _LOADED:
            _LOADED[tokenizer_file] = WordIds(tokenizer_file)
        encode, end = _LOADED[tokenizer_file].text, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            docs, piece, start, length, crc = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = (encode(text) if text else b"") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    docs.append(doc)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; lengths must not grow. Open bins stand by their room; a set bit in ``rooms``
    says that some bin has that room, so the tightest fit is the lowest bit from the length on."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, opened = 0, 0
    for i, n in enumerate(lengths.tolist()):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, at, opened = capacity, opened, opened + 1
        bins[i], offsets[i] = at, capacity - room
        if left := room - n:
            by_room[left].append(at)
            rooms |= 1 << left
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing of these lengths needs."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1), capacity)


def bound_of_counts(count: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs of ``count[n]`` pieces of each length n: the best of several dual feasible functions.

    Threshold functions take a length over capacity - e as a whole bin and one below e as nothing; rounding functions
    take x as floor((k + 1) x) / k unless (k + 1) x is whole."""
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    many, mass = np.cumsum(count[::-1])[::-1], np.cumsum(count * size)
    for e in range(1, capacity // 2 + 1):
        whole = int(many[capacity - e + 1])
        part = int(mass[capacity - e] - mass[e - 1])
        best = max(best, whole + -(-part // capacity))
    for k in range(1, 20):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)  # in 1 / (k * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


PACKED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, grp bigint, bin bigint, offset bigint, gap bigint, fill bigint"


def _pack_groups(pieces: DataFrame, capacity: int) -> DataFrame:
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        sizes = group["length"].to_numpy()
        bins, offsets = best_fit_decreasing(sizes, capacity)
        used = int(bins.max()) + 1
        fill = np.bincount(bins, weights=sizes, minlength=used).astype(np.int64)
        return group.assign(bin=bins, offset=offsets, gap=used - lower_bound(sizes, capacity), fill=fill[bins])

    return pieces.groupBy("grp").applyInPandas(pack, PACKED)


def least_sequences(pieces: DataFrame, capacity: int) -> int:
    """The lower bound over all pieces, from the histogram of their lengths: at most ``capacity`` rows come to the driver."""
    count = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():
        count[row["length"]] = row["count"]
    return bound_of_counts(count, capacity)


def _emptiest(state: DataFrame, capacity: int, per_group: int) -> int:
    """Up to which fill the emptiest bins with room hold no more than ``per_group`` pieces; the smallest fill at least. At most
    ``capacity`` rows come to the driver."""
    held = sorted((r["fill"], r["count"]) for r in state.where(F.col("fill") < capacity).groupBy("fill").count().collect())
    up_to, total = held[0][0] if held else 0, 0
    for fill, n in held:
        total += n
        if total > per_group:
            break
        up_to = fill
    return up_to


def pack(pieces: DataFrame, capacity: int = 2048, per_group: int = 150_000, rounds: int = 4) -> DataFrame:
    """Adds sequence_id, offset, sequence_length and least_sequences (the bound over all pieces) to pieces (doc_id, piece, start,
    length, ids_crc32).

    per_group: about as many pieces are packed by one task, whatever the table's size. rounds: reruns at most; the
    result is whole after any of them. Groups whose own bound is not met exchange pieces first. When that saves nothing, the
    emptiest bins of all groups, certified groups' too, as many as one task packs, are packed once more, unless all bins together
    meet ``least_sequences``.
    Only counts come to the driver."""
    pieces = written(pieces, "pieces")
    # a row's number goes into the deal, so equal rows are spread as well
    deal = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "doc_id", "piece", "length", F.monotonically_increasing_id()), F.lit(n)).cast("long")
    least = least_sequences(pieces, capacity)
    groups = n = max(1, -(-pieces.count() // per_group))
    state = written(_pack_groups(pieces.withColumn("grp", deal(0, n)), capacity), "packed")
    has_room, opens, of_all = F.col("fill") < capacity, F.col("offset") == 0, n == 1  # each bin has one piece at 0
    for again in range(1, rounds + 1):
        loose = has_room & (F.col("fill") <= _emptiest(state, capacity, per_group) if of_all else F.col("gap") > 0)
        had = state.agg(F.count_if(opens).alias("all"), F.count_if(opens & loose).alias("bins"), F.count_if(loose).alias("pieces")).first()
        if had["all"] <= least:
            break  # certified over all pieces
        n = max(1, -(-had["pieces"] // per_group))
        rows = state.where(loose).select("doc_id", "piece", "start", "length", "ids_crc32").withColumn("grp", F.lit(groups) + deal(again, n))
        groups, rerun = groups + n, written(_pack_groups(rows, capacity), "packed")
        if rerun.where(opens).count() < had["bins"]:
            state = state.where(~loose).unionByName(rerun)
        elif of_all:
            break
        else:
            of_all = True
    sequence = F.col("grp") * F.lit(1 << 32) + F.col("bin")
    return state.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), "offset", F.col("fill").alias("sequence_length"), F.lit(least).cast("long").alias("least_sequences"))


def pack_documents(df: DataFrame, tokenizer_file: str, capacity: int = 2048, **options) -> DataFrame:
    return pack(document_pieces(df, tokenizer_file, capacity), capacity, **options)
