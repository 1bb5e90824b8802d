"""Periodic runs of words: maximal stretches that repeat their first words three times or more.

The words of a batch of texts, a mark of its own between texts, are compressed in rounds that alternate: blocks of an equal symbol become
one symbol with a length, then pairs of a symbol of one half of the alphabet and one of the other become a symbol. The rounds are a
run-length grammar in which equal stretches get equal symbols but for a few at their ends, so how far two places agree is found by going
up the rounds while the symbols agree and down again where they differ: the longest common extension, to the right and mirrored to the left.

A run with period q has, for a step g <= its length - q, a multiple of g at which the word equals the one q later. So for every q the places
0, g, 2g, ... with g = max(least - q, (repeats - 1) * q) are enough: of n words about n log n / 2 places, few of which have equal words. Their exact extensions
give the maximal stretches; of stretches with the same ends the smallest period counts (the others are its multiples).

Nulls and texts without words have no runs. A text of any length is taken whole, in one task. Runs may overlap; each is listed, ordered by start, then
period. Repeated rows and ties make no difference, extra columns are kept, those named like a result are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, add_columns, let, words

#: Words that are compressed at a time, but for a longer text; candidate places that are compared at a time.
SLICE_WORDS, SLICE_PLACES = 400_000, 2_000_000
ROUNDS = 80


class Grammar:
    """Rounds of compression over an array of symbols whose first and last are found nowhere else. A round is built when a query first gets there."""

    def __init__(self, symbols: np.ndarray):
        self.rounds = [symbols.astype(np.int64)]
        self.first: list[np.ndarray] = []  # of each symbol of round r + 1 where it begins in round r, and one end
        self.parent: list[np.ndarray] = []  # of each symbol of round r the one of round r + 1 that holds it
        self.next_symbol = int(symbols.max()) + 1

    def has(self, r: int) -> bool:
        """Builds round r if there is one."""
        while len(self.rounds) <= r:
            if len(self.rounds) > ROUNDS or len(self.rounds[-1]) < 3:
                return False
            self._compress(len(self.rounds) - 1)
        return True

    def right_half(self, r: int, symbols: np.ndarray) -> np.ndarray:
        """Whether symbols may be the second of a pair in round r; the others may be the first."""
        mixed = (symbols + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 ^ (r * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFE))
        return (mixed >> np.uint64(40)) & np.uint64(1) == 1

    def _compress(self, r: int) -> None:
        s = self.rounds[r]
        if r % 2 == 0:
            begins = np.r_[True, s[1:] != s[:-1]]
        else:
            right = self.right_half(r, s)
            begins = np.r_[True, right[:-1] | ~right[1:]]
        first = np.r_[np.flatnonzero(begins), len(s)]
        size = np.diff(first)
        up = s[first[:-1]]
        made = np.flatnonzero(size > 1)
        if len(made):
            other = size[made] if r % 2 == 0 else s[first[made] + 1]
            _, number = np.unique(up[made] * (int(other.max()) + 1) + other, return_inverse=True)
            up = up.copy()
            up[made] = self.next_symbol + number
            self.next_symbol += int(number.max()) + 1
        self.rounds.append(up)
        self.first.append(first)
        self.parent.append(np.cumsum(begins) - 1)

    def extension(self, x: np.ndarray, y: np.ndarray, way: int) -> np.ndarray:
        """How many symbols from x on and from y on agree, to the right (way 1) or to the left (way -1); x differs from y."""
        at_x, at_y, height = x.copy(), y.copy(), np.zeros(len(x), np.int64)
        alive, r = np.arange(len(x)), 0
        while len(alive):
            s = self.rounds[r]
            alive = alive[s[at_x[alive]] == s[at_y[alive]]]
            if not self.has(r + 1):
                at_x[alive] += way
                at_y[alive] += way
                continue
            a, b = at_x[alive], at_y[alive]
            step, other = self._to_edge(r, a, way), self._to_edge(r, b, way)
            going = step == other  # of blocks with unlike rests the longer goes on where the shorter ends: they differ there
            if r % 2 == 0:
                # both at the edge of a symbol of the next round: nothing is skipped, the symbols there tell whether they agree
                edge = (step == self._whole(r, a)) & (other == self._whole(r, b))
                step, going = np.where(edge, 0, np.minimum(step, other)), going | edge
            at_x[alive], at_y[alive] = a + way * step, b + way * step
            alive = alive[going]
            at_x[alive], at_y[alive] = self.parent[r][at_x[alive]], self.parent[r][at_y[alive]]
            height[alive] = r = r + 1
        for r in range(int(height.max(initial=0)), 0, -1):
            here = np.flatnonzero(height == r)
            down = self.first[r - 1]
            a, b = (down[v[here]] if way == 1 else down[v[here] + 1] - 1 for v in (at_x, at_y))
            s = self.rounds[r - 1]
            same = s[a] == s[b]
            step = np.minimum(self._to_edge(r - 1, a, way), self._to_edge(r - 1, b, way)) if (r - 1) % 2 == 0 else 1
            at_x[here], at_y[here] = a + way * np.where(same, step, 0), b + way * np.where(same, step, 0)
            height[here] = r - 1
        return (at_x - x) * way

    def _whole(self, r: int, at: np.ndarray) -> np.ndarray:
        p = self.parent[r][at]
        return self.first[r][p + 1] - self.first[r][p]

    def _to_edge(self, r: int, at: np.ndarray, way: int) -> np.ndarray:
        """Symbols of round r from here to the far edge of the block, or, where pairs are made, whether the symbol's neighbour on
        the near side may be in its pair: then it is passed over."""
        if r % 2:
            return (self.right_half(r, self.rounds[r][at]) == (way == 1)).astype(np.int64)
        p = self.parent[r][at]
        return self.first[r][p + 1] - at if way == 1 else at - self.first[r][p] + 1


def places(lengths: np.ndarray, least: int, repeats: int):
    """Text, period and place (within the text) of all candidates, in bounded parts; lengths: words of each text."""
    text = np.repeat(np.arange(len(lengths)), np.where(lengths >= least, lengths // repeats, 0))
    heads = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else np.zeros(0, np.int64)
    period = np.arange(len(text)) - np.repeat(heads, np.diff(np.r_[heads, len(text)])) + 1
    grid = np.maximum(least - period, (repeats - 1) * period)
    count = (lengths[text] - 1 - period) // grid + 1
    total = np.cumsum(count)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + SLICE_PLACES)))
        n = count[lo:hi]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(text[lo:hi], n), np.repeat(period[lo:hi], n), at * np.repeat(grid[lo:hi], n)
        lo = hi


def runs_of_texts(texts: list[list[bytes]], least: int, repeats: int) -> np.ndarray:
    """text, start, length, period of every run, in this order."""
    lengths = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(lengths + 1) - lengths  # a mark stands before each text, one behind the last
    codes, _ = pd.factorize(np.array([w for t in texts for w in t] or [b""], object))
    kinds = int(codes.max()) + 1
    flat = np.empty(int(lengths.sum()) + len(texts) + 1, np.int64)
    marks = np.r_[base - 1, len(flat) - 1]
    is_word = np.ones(len(flat), bool)
    is_word[marks] = False
    flat[marks] = kinds + np.arange(len(marks))
    flat[is_word] = codes[: int(lengths.sum())]
    grammar, found = Grammar(flat), []
    for text, period, at in places(lengths, least, repeats):
        x = base[text] + at
        y = x + period
        same = flat[x] == flat[y]
        text, period, x, y = text[same], period[same], x[same], y[same]
        start = x - grammar.extension(x - 1, y - 1, -1)
        length = y + grammar.extension(y, x, 1) - start
        long = length >= np.maximum(least, repeats * period)
        found.append(np.unique(np.stack([text, start - base[text], length, period], axis=1)[long], axis=0))
    rows = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)] if len(rows) else np.zeros(0, bool)
    rows = rows[new]  # of equal ends the smallest period
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def periodic_runs(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, least: int = 24, repeats: int = 3) -> DataFrame:
    """Adds n_words, runs (array of start, length, period in words) and collapsed to the columns ``keep`` (None: all).

    A run is at least ``least`` words and ``repeats`` periods long. collapsed: the words joined by one space without those that some run holds behind its first period."""
    if least < 2 or repeats < 2:
        raise ValueError("a run has two periods and two words at least")

    def some(texts: list[list[bytes]]) -> tuple[list, list]:
        rows = runs_of_texts(texts, least, repeats)
        cuts = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1)).tolist()
        out, left = [], []
        for t, lo, hi in zip(texts, cuts, cuts[1:]):
            if lo < hi:
                _, start, length, period = rows[lo:hi].T
                depth = np.zeros(len(t) + 1, np.int64)
                np.add.at(depth, start + period, 1)
                np.add.at(depth, start + length, -1)
                t = [w for w, d in zip(t, np.cumsum(depth).tolist()) if d == 0]
            out.append(rows[lo:hi, 1:])
            left.append(b" ".join(t).decode())
        return out, left

    def each(texts: list) -> list[pa.Array]:
        n, runs, left, part, size = [], [], [], [], 0
        for at, text in enumerate(texts, 1):
            part.append(words(text))
            n.append(len(part[-1]))
            size += n[-1]
            if size >= SLICE_WORDS or at == len(texts):
                more, kept = some(part)
                runs, left, part, size = runs + more, left + kept, [], 0
        flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
        items = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
        offsets = pa.array(np.r_[0, np.cumsum([len(x) for x in runs])].astype(np.int32))
        return [pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, items), pa.array(left, pa.string())]

    return add_columns(df, text_col, keep, "n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string", lambda: each)


def planted(doc_id: Column, text: Column) -> Column:
    """The text with runs planted in one of ten documents: with h the checksum of the id and g = h / 10, each word from a = g % n on is the
    one (i - a) % p behind a, p = 1 + (n - a) / (3 + g % 8). A null id leaves the text as it is."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(held: Column) -> Column:
        n = F.size(held)

        def turned(bounds: Column) -> Column:
            word = lambda i: F.get(held, F.when(i < bounds.a, i).otherwise(bounds.a + (i - bounds.a) % bounds.p).cast("int"))
            return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " ")

        a = g % n
        return F.when(n > 0, let(F.struct(a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).alias("p")), turned)).otherwise(text)

    held = F.filter(F.split(text, BLANKS), lambda w: w != "")
    return F.when(text.isNotNull() & (h % 10 == 0), let(held, repeated)).otherwise(text)


def runs_report(df: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli of the run with the greatest length / period (null without a run), and digests
    of all runs and of the collapsed text, over the texts with runs planted."""
    texts = df.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    done = periodic_runs(texts, keep=["doc_id"])
    further = lambda l, r: l.length * r.period - r.length * l.period  # noqa: E741, E731
    order = lambda l, r: F.when(further(l, r) != 0, F.signum(further(r, l))).when(l.start != r.start, F.signum(l.start - r.start)).otherwise(F.signum(l.period - r.period)).cast("int")  # noqa: E741, E731
    best = F.get(F.array_sort("runs", order), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    rows = done.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), digest(lines).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))
    exponent = F.expr("1000 * best.length DIV best.period").alias("exponent_milli")
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent, "runs_sha256", "collapsed_sha256")
