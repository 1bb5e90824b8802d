"""Periodic runs, hard negatives and the piece codec against brute force, the library, and odd rows."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from gatelens.llm import hard_negatives, periodic_runs, piece_codec
from gatelens.llm.queries import tokenizer_path

from ..oracle import compare
from .test_odd_tables import CLASHING, ROWS, rows

MODEL = "piece_bpe_32k.model"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def runs_by_hand(t, least=24, repeats=3):
    found = {}
    for q in range(1, len(t) // repeats + 1):
        i = 0
        while i + q < len(t):
            j = i
            while j + q < len(t) and t[j] == t[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, repeats * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((start, q, length) for (start, length), q in found.items())


def repetitive(rng):
    words, kinds = [], rng.choice([1, 2, 3, 5, 50])
    for _ in range(rng.randint(0, 6)):
        unit = [f"w{rng.randint(0, kinds)}" for _ in range(rng.randint(1, 12))]
        words += (unit * rng.randint(1, 40))[: rng.randint(1, 200)] if rng.random() < 0.5 else [f"w{rng.randint(0, kinds)}" for _ in range(rng.randint(0, 40))]
    return words


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_brute_force(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(periodic_runs, "SLICE_PLACES", rng.choice([50, 2_000_000]))
    texts = [repetitive(rng) for _ in range(30)]
    got = periodic_runs.runs_of_texts([[w.encode() for w in t] for t in texts], 24, 3).tolist()
    assert got == [[i, start, length, q] for i, t in enumerate(texts) for start, q, length in runs_by_hand(t)]


def report_by_hand(doc_id, text):
    words = (text or "").encode().split()
    words = [w.decode() for w in words]
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = runs_by_hand(words)
    drop = {i for s, q, length in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[2], r[1]), r[0], r[1]), default=None)
    top = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    return (len(runs), *top, sha("".join(f"{s},{length},{q}\n" for s, q, length in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_runs_report_equals_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t ", "one", "é " * 30, "a b c " * 9 + "a b", "a " * 23, "a " * 24] + [" \n".join(repetitive(rng)) for _ in range(120)]
    data = [*enumerate(texts), (None, "x y " * 20), (3, "again " * 40), (3, "again " * 40)]
    got = periodic_runs.runs_report(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *report_by_hand(i, t))) for i, t in data)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in data) > 5


def test_runs_of_a_long_text():
    rng = random.Random(1)
    words = [b"w%d" % rng.randint(0, 9000) for _ in range(150_000)]
    words[70_000:75_000] = words[70_000:70_007] * 800
    (run,) = periodic_runs.runs_of_texts([words], 24, 3).tolist()
    assert run[1] <= 70_000 and run[3] == 7 and run[1] + run[2] >= 75_600


VECTORS = "vec_id long, embedding array<float>, label int"


def negatives_by_hand(data):
    floor = lambda v: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)
    use = [(i, (y + 1) % 10 if i % 7 == 0 else y, floor(v)) for i, v, y in data if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, y, v in use:
        if i % 50:
            continue
        scored = sorted(((-int(v @ w), j, z) for j, z, w in use if j != i))
        for p, j, _ in [s for s in scored if s[2] == y][:5]:
            fit = [s for s in scored if s[2] != y and 50 * -p <= 100 * -s[0] <= 95 * -p]
            out += [(i, j, rank, k, -p, -s) for rank, (s, k, _) in enumerate(fit[:3], 1)]
    return sorted(out)


@pytest.mark.parametrize("small_blocks", [False, True])
def test_negatives_equal_brute_force(spark, monkeypatch, small_blocks):
    if small_blocks:  # several groups, tiles, packs of zone maps, and a first pass
        for name, size in {"GROUP": 5, "ZONES": 4, "TILE": 3, "SEEDS": 2}.items():
            monkeypatch.setattr(hard_negatives, name, size)
        keep = hard_negatives.hard_negatives
        monkeypatch.setattr(hard_negatives, "hard_negatives", lambda *a: keep(*a, block=16))
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8))
    data = []
    for i in range(700):
        v = centres[rng.integers(12)] + 0.3 * rng.normal(size=8)
        data.append((i, [float(x) for x in (v / np.linalg.norm(v)).astype(np.float32)], int(rng.integers(3)) if i % 3 else 4))
    data += [(1000 + i, data[5][1], i % 2) for i in range(300)]  # one vector many times, with ties
    data += [(2000, None, 1), (2050, [1.0] * 7 + [None], 1), (2100, [float("nan")] * 8, 1), (2150, [float("inf")] + [0.0] * 7, 1), (2200, [0.5] * 8, None), (None, [0.5] * 8, 2), (2250, [0.0] * 8, 2)]
    df = spark.createDataFrame(data, VECTORS).withColumn("group", F.lit("x")).withColumn("v", F.lit("y"))
    assert sorted(map(tuple, hard_negatives.negatives_report(df).collect())) == negatives_by_hand(data)


def test_negatives_on_repeated_ids_large_numbers_and_nothing(spark):
    assert hard_negatives.negatives_report(spark.createDataFrame([], VECTORS)).count() == 0
    row = lambda i, y, v: (i, [float(x) for x in v], y)
    data = [row(50, 1, [3e6, 0]), row(50, 1, [3e6, 0]), row(1, 1, [2e6, 5]), row(1, 1, [2e6, 5]), row(2, 2, [1.5e6]), row(3, 2, []), row(4, 2, [1.95e6, 9, 9])]
    got = hard_negatives.negatives_report(spark.createDataFrame(data, VECTORS)).collect()
    assert {(r.anchor_id, r.positive_id, r.rank, r.negative_id) for r in got} == {(50, 1, 1, 2)} and len(got) == 2  # both rows under 1 are positives
    assert {r.negative_score for r in got} == {256 * 3_000_000 * 256 * 1_500_000}


def test_hilbert_curve_steps_to_neighbours():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = hard_negatives.hilbert_keys(cells, bits)
        order = sorted(range(len(cells)), key=keys.__getitem__)
        assert len(set(keys)) == len(cells)
        assert (np.abs(np.diff(cells[order].astype(int), axis=0)).sum(axis=1) == 1).all()


def test_negatives_equal_sql(spark):
    compare(spark, "op12_negatives")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(MODEL))


def test_codec_equals_library_on_random_texts(library):
    rng = random.Random(6)
    parts = ["a", "ab", " ", "  ", "e", "er", "the", "\n", "\t", "é", "中", "😀", "▁", "<s>", "</s>", "<0x0A>", "\0", "1", "ﬁ", "in", "ing", "aaaa", "ز", "n", ".", "​", "�"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + [" ", "▁", "a" * 3000, " " * 1000, "ab" * 2000, "\0", "banana" * 500]
    codec = piece_codec.Codec(tokenizer_path(MODEL), cache=100)
    for at in range(0, len(texts), 500):
        ids = codec.encode(texts[at : at + 500])
        assert [x.tolist() for x in ids] == library.encode(texts[at : at + 500], add_eos=True)
        assert [codec.decode(x) for x in ids] == library.decode([x.tolist() for x in ids])


def test_codec_report(spark, library):
    texts = [r[1] for r in ROWS] + ["x" * 100_000 + " word" * 50_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = {}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_eos=True)
        want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))
    assert {r[0]: tuple(r)[1:] for r in piece_codec.codec_report(df, tokenizer_path(MODEL)).collect()} == want


def test_codec_refuses_other_models(tmp_path):
    other = tmp_path / "other.model"
    other.write_bytes(b"")
    with pytest.raises(ValueError):
        piece_codec.Vocabulary(str(other))


@pytest.mark.parametrize("run", [periodic_runs.runs_report, lambda df: piece_codec.codec_report(df, tokenizer_path(MODEL))])
def test_odd_rows(spark, run):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    crowded = plain.select("*", *[F.lit(c).alias(c) for c in [*CLASHING, "runs", "collapsed", "ids", "decoded", "best"]])
    assert rows(run(crowded)) == rows(run(plain)) and run(plain).count() == len(ROWS)
    assert run(plain.limit(0)).count() == 0
