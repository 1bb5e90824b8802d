"""Removal of repeated passages: every word under a window of ``width`` words whose sequence also starts elsewhere.

Super-k-mers: the windows of a text are cut into runs that share a minimiser, the leftmost smallest hash of ``grams`` words
in a window. A run travels as one packed string to the bucket of its minimiser, where windows are sorted and counted
exactly. Equal windows have their minimiser at the same place, so windows of one run differ, a bucket with one run
needs no work, and equal packed strings are whole runs of repeats. The packing is exact: frequent words have codes of one or two
bytes, others are spelled out, so equal strings are equal word sequences.

Hot buckets are split where runs are made: a task sends a string to its bucket twice at most, since two suffice to
count it, and settles later copies itself; after ``spread`` runs for one bucket it marks the bucket and hands the rest on
to any task. A marked bucket, or one with more distinct strings than ``bucket_limit``, is not held: its windows
go, one row each, through a grouped count and a join on the window, again twice a task at most. So what one task reads of a
bucket or window is bounded by the number of tasks, not of copies. Results do not depend on the limits. What a task settles
depends on the order of its rows, so an input that is not read from files should be written first.

Words are ``[^\\x20\\x09-\\x0D]+``; a null or empty text has none. Texts of any length are read whole. Repeated rows are occurrences like any
others; rows with equal id and text get equal results. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TwoGenerations, frequent_pieces, words, written

#: One-byte codes, then first bytes of two-byte codes; 255 opens a word that is spelled out and closed by a space.
SHORT, ESCAPE = 200, 255
CODES = SHORT + (ESCAPE - SHORT) * 256 - 256
#: Words of a text that are worked on at once, at least.
CHUNK = 60_000
#: States of a run: to be counted in its bucket, known as a repeat, to be counted window by window.
COUNT, REPEAT, OPEN = 0, 1, 2


class Sent:
    """How often a task has sent a string or to a bucket, in bounded memory: what was forgotten is only sent again."""

    def __init__(self, size: int = 100_000, longest: int = 600):
        self.times, self.longest = TwoGenerations(size), longest

    def twice(self, string: bytes) -> bool:
        """Whether it has been sent twice before; else it is noted as sent now."""
        if (n := self.times.get(string) or 0) == 2:
            return True
        if len(string) <= self.longest:
            self.times.put(string, n + 1)
        return False

    def next(self, bucket: int) -> int:
        n = (self.times.get(bucket) or 0) + 1
        self.times.put(bucket, n)
        return n


class Packer(dict):
    """word -> (code, 64-bit hash). Frequent words are entries; others are made when they come and cached."""

    def __init__(self, frequent: list[bytes], cache: int = 150_000):
        super().__init__()
        for rank, word in enumerate(frequent[:CODES]):
            q = rank - SHORT
            self[word] = (bytes([rank]) if q < 0 else bytes([SHORT + q // 256, q % 256]), xxhash.xxh3_64_intdigest(word))
        self.cache = TwoGenerations(cache)

    def __missing__(self, word: bytes) -> tuple[bytes, int]:
        if (found := self.cache.get(word)) is None:
            found = (b"\xff" + word + b" ", xxhash.xxh3_64_intdigest(word))
            if len(word) <= 64:
                self.cache.put(word, found)
        return found


def boundaries(packed: bytes) -> list[int]:
    """Where the words of a packed string start, and its end."""
    at, out = 0, []
    while at < len(packed):
        out.append(at)
        first = packed[at]
        at = at + 1 if first < SHORT else at + 2 if first < ESCAPE else packed.index(b" ", at) + 1
    return [*out, at]


def minimisers(hashes: np.ndarray, width: int, grams: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window its minimiser's position and, for each position, the hash of the words from there."""
    n = len(hashes) - grams + 1
    mixed = np.zeros(n, np.uint64)
    for i in range(grams):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    span, best, at, have = width - grams + 1, mixed, np.arange(n), 1
    while have < span:
        step = min(have, span - have)
        left, right = best[:-step], best[step:]
        pick = left <= right
        best, at = np.where(pick, left, right), np.where(pick, at[:-step], at[step:])
        have += step
    return at, mixed


PARTS = "k bigint, doc_id bigint, th bigint, at bigint, lead int, n int, packed binary, state tinyint"


def super_kmers(df: DataFrame, frequent: list[bytes], width: int, grams: int, spread: int) -> DataFrame:
    """PARTS for each run of windows: bucket, row, first word, words before the minimiser, windows, packed words, state.

    Runs that need not meet others of their bucket get a number of their own for it. An empty string marks a bucket
    whose runs are all to be counted window by window."""
    shared = df.sparkSession.sparkContext.broadcast(frequent)  # at most CODES words of at most 32 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(shared.value)
        strings, buckets = Sent(), Sent()
        passed = TaskContext.get().partitionId() << 40

        def deal(k: np.ndarray, packed: list[bytes | None]) -> tuple[np.ndarray, list[int]]:
            """States of the runs, and the buckets to mark; settles repeats in ``packed`` and spreads ``k``."""
            nonlocal passed
            state, marks = np.zeros(len(k), np.int8), []
            for i, (bucket, string) in enumerate(zip(k.tolist(), packed)):
                if strings.twice(string):
                    state[i], packed[i] = REPEAT, None
                elif (n := buckets.next(bucket)) > spread:
                    state[i] = OPEN
                    if n == spread + 1:
                        marks.append(bucket)
            free = np.flatnonzero(state)
            k[free] = np.arange(passed, passed + len(free)) * 0x1E3779B97F4A7C15
            passed += len(free)
            return state, marks

        def cut(docs: list[tuple[int, int, list[bytes]]]) -> pa.RecordBatch:
            sizes = np.array([len(w) for _, _, w in docs])
            pairs = [packer[w] for _, _, found in docs for w in found]
            codes = [c for c, _ in pairs]
            ends = np.cumsum([0, *map(len, codes)])
            blob = b"".join(codes)
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            of = np.repeat(np.arange(len(docs)), sizes)
            at, mixed = minimisers(np.array([h for _, h in pairs], np.uint64), width, grams)
            start = np.arange(len(at))
            inside = of[start] == of[start + width - 1]
            start, at = start[inside], at[inside]
            new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (of[start[1:]] != of[start[:-1]])]))
            lo, hi = start[new], start[np.concatenate([new[1:], [len(start)]]) - 1]
            owner = of[lo]
            packed = [blob[a:b] for a, b in zip(ends[lo].tolist(), ends[hi + width].tolist())]
            ids, th = pa.array([d for d, _, _ in docs], pa.int64()), pa.array([t for _, t, _ in docs], pa.int64())
            k = mixed[at[new]].view(np.int64)
            state, marks = deal(k, packed)
            none = pa.nulls(len(marks), pa.int64())
            columns = [pa.array(k), ids.take(pa.array(owner)), th.take(pa.array(owner)), pa.array((lo - first[owner]).astype(np.int64)), pa.array((at[new] - lo).astype(np.int32)), pa.array((hi - lo + 1).astype(np.int32)), pa.array(packed, pa.binary()), pa.array(state)]
            marking = [pa.array(marks, pa.int64()), none, none, none, none.cast(pa.int32()), none.cast(pa.int32()), pa.array([b""] * len(marks), pa.binary()), pa.array([COUNT] * len(marks), pa.int8())]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(pair) for pair in zip(columns, marking)], ["k", "doc_id", "th", "at", "lead", "n", "packed", "state"])

        for batch in batches:
            held, size = [], 0
            for doc, th, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = words(text)
                if len(found) >= width:
                    held.append((doc, th, found))
                    size += len(found)
                if size >= CHUNK:
                    yield cut(held)
                    held, size = [], 0
            if held:
                yield cut(held)

    return df.select("doc_id", "th", "text").mapInArrow(run, PARTS)


SPANS = "doc_id bigint, th bigint, lo bigint, hi bigint, lead int, n int, packed binary"


def count_windows(parts: DataFrame, width: int, bucket_limit: int) -> DataFrame:
    """SPANS: word ranges under repeated windows; or, with ``packed``, runs of buckets over the limit, still to be counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        bucket: dict[bytes, list] = {}  # packed -> [first owner or None once it has been reported, lead, n]
        too_many = False
        before = None

        def settle() -> None:
            """Counts the windows of the bucket's distinct strings by sorting; a string met twice is a repeat as a whole."""
            if len(bucket) < 2:
                return
            windows = []
            for i, (packed, (_, lead, n)) in enumerate(bucket.items()):
                edge = boundaries(packed)
                windows += [(lead - j, packed[edge[j] : edge[j + width]], i, j) for j in range(n)]
            windows.sort()
            twice: dict[int, list[int]] = {}
            for a, b in zip(windows, windows[1:]):
                if a[:2] == b[:2]:
                    twice.setdefault(a[2], []).append(a[3])
                    twice.setdefault(b[2], []).append(b[3])
            for i, (owner, _, _) in enumerate(bucket.values()):
                if owner and i in twice:
                    lo = hi = None
                    for j in sorted(twice[i]):
                        if hi is not None and j <= hi + 1:
                            hi = j
                            continue
                        if hi is not None:
                            out.append((owner[0], owner[1], owner[2] + lo, owner[2] + hi + width, None, None, None))
                        lo = hi = j
                    out.append((owner[0], owner[1], owner[2] + lo, owner[2] + hi + width, None, None, None))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 7
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()])], ["doc_id", "th", "lo", "hi", "lead", "n", "packed"])

        last = None
        for batch in batches:
            state = batch.column(7).to_numpy()
            if state.any():
                ready = batch.filter(pa.array(state != COUNT))
                ends = ready.column(3).to_numpy() + ready.column(5).to_numpy() + (width - 1)
                yield pa.RecordBatch.from_arrays([*ready.columns[1:4], pa.array(ends, mask=state[state != COUNT] == OPEN), *ready.columns[4:7]], ["doc_id", "th", "lo", "hi", "lead", "n", "packed"])
                batch = batch.filter(pa.array(state == COUNT))
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            same = keys[1:] == keys[:-1]
            shared = np.append(same, True)  # the last one's bucket may go on in the next batch
            shared[1:] |= same
            shared[0] |= keys[0] == before
            before = keys[-1]
            for key, doc, th, at, lead, n, packed in zip(*(c.to_pylist() for c in batch.filter(pa.array(shared)).columns[:7])):
                if key != last:
                    settle()
                    bucket, too_many, last = {}, False, key
                if not packed:
                    too_many = True
                elif too_many:
                    out.append((doc, th, at, None, lead, n, packed))
                elif (seen := bucket.get(packed)) is None:
                    bucket[packed] = [(doc, th, at), lead, n]
                    if len(bucket) > bucket_limit:
                        for p, (owner, le, k) in bucket.items():
                            if owner:
                                out.append((*owner, None, le, k, p))
                            else:  # reported already; one occurrence more keeps its windows repeated for the others
                                out.append((None, None, None, None, le, k, p))
                        bucket, too_many = {}, True
                else:
                    if seen[0]:
                        d, t, a = seen[0]
                        out.append((d, t, a, a + seen[2] + width - 1, None, None, None))
                        seen[0] = None
                    out.append((doc, th, at, at + n + width - 1, None, None, None))
                if len(out) > 50_000:
                    yield flush()
        settle()
        yield flush()

    dealt = parts.repartition("k").sortWithinPartitions("k", "packed")
    return dealt.mapInArrow(run, SPANS)


def spread_windows(left_open: DataFrame, width: int) -> DataFrame:
    """doc_id, th, lo, hi for the repeated windows of runs that no bucket could hold: counted by grouping, then joined back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = Sent()
        for batch in batches:
            rows = []
            for doc, th, lo, n, packed in zip(*(batch.column(i).to_pylist() for i in range(5))):
                edge = boundaries(packed)
                for j in range(n):
                    window = packed[edge[j] : edge[j + width]]
                    rows.append((doc, th, lo + j if lo is not None else None, None if sent.twice(window) else window))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.binary()])], ["doc_id", "th", "lo", "window"])

    windows = left_open.select("doc_id", "th", "lo", "n", "packed").mapInArrow(run, "doc_id bigint, th bigint, lo bigint, window binary")
    twice = windows.where("window is not null").groupBy("window").count().where("count > 1").select("window")
    found = windows.where("lo is not null and window is not null").join(twice, "window").select("doc_id", "th", "lo")
    return found.unionByName(windows.where("lo is not null and window is null").select("doc_id", "th", "lo")).withColumn("hi", F.col("lo") + width)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35, grams: int = 6, bucket_limit: int = 4_000, spread: int = 256, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed (long), kept_sha256 and, with_text, the kept words joined by one space."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("th"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    frequent = frequent_pieces(docs, "text", lambda t: t.encode().split(), CODES)
    found = written(count_windows(super_kmers(docs, frequent, width, grams, spread), width, bucket_limit), "spans")
    spans = found.where("packed is null").select("doc_id", "th", "lo", "hi")
    left_open = found.where("packed is not null")
    if not left_open.isEmpty():
        spans = spans.unionByName(spread_windows(left_open, width))
    spans = spans.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("h")).agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    rows = docs.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = words(text)
                kept, end = [], 0
                for r in sorted(ranges or [], key=lambda r: r["lo"]):
                    kept += found[end : max(end, r["lo"])]
                    end = max(end, r["hi"])
                kept = b" ".join(kept + found[end:] if ranges else found)
                left = kept.count(b" ") + 1 if kept else 0
                out.append((len(found), len(found) - left, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 2 + [pa.string()] * 2))], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    out = rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")
    return out if with_text else out.drop("kept_text")


#: DuckDB SQL for the rows over ``documents``: all windows, grouped.
ORACLE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w FROM documents),
starts AS (SELECT rid, unnest(range(1, len(w) - 33)) AS s FROM docs WHERE len(w) >= 35),
windows AS (SELECT rid, s, array_to_string(list_slice(w, s, s + 34), ' ') AS seq FROM starts JOIN docs USING (rid)),
twice AS (SELECT rid, s FROM windows WHERE seq IN (SELECT seq FROM windows GROUP BY seq HAVING count(*) > 1)),
gone AS (SELECT DISTINCT rid, unnest(range(s, s + 35)) AS i FROM twice),
kept AS (SELECT rid, list(i) AS gone FROM gone GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM docs LEFT JOIN kept USING (rid)"""
