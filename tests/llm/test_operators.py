"""Operators against plain versions and on tables with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from gatelens.llm import html_extract, license_scan, minhash_dedup, packing, quality_rules, secret_scan, simhash, source_mixing, substring_dedup, token_counts
from gatelens.llm.common import connected_components, frequent_pieces, join_hot
from gatelens.llm.queries import ORACLE_SQL, tokenizer_path

from ..oracle import compare

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    vocabulary = [word() for _ in range(400)]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    shared = prose(50)
    texts = [None, "", "  \n\t ", "one", prose(5000), shared, shared, shared + " x"] + [prose(rng.randint(1, 120)) for _ in range(n)]
    texts += [prose(30) + "\n" + shared + " " + prose(20) for _ in range(6)]
    base = prose(200).split()
    for k in range(12):
        copy = list(base)
        copy[17 * k % 200] = "changed" + "abcdefghijkl"[k]
        texts.append(" ".join(copy))
    texts += ['password = "hunter22" token: abc123x', "AKIA" + "A1" * 9 + " " + "0f" * 15, "key 8fJ2kQ9zLm4Xw7Rt1VbN5cYs here", "Released under the MIT License."]
    return [(i, t, "en", f"src{i % 5}", 0) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_equal_sql(spark, name):
    compare(spark, name)


def test_token_counts_equal_the_library(spark, docs, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = token_counts.token_counts(docs.withColumn("N_TOKENS", docs.n_chars), tokenizer_path("piece_bpe_32k.model"), keep=["doc_id", "N_TOKENS"]).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == {i: (len((t or "").encode()), len(model.encode(t or ""))) for i, t, *_ in corpus()}
    assert token_counts.token_counts(empty, tokenizer_path("piece_bpe_32k.model")).count() == 0


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "  ", "a\nb", "a \n\n b", "\ta", "a▁b", "<s>x</s>", "é\n  é ", "\r\n", "日 本"])
def test_pre_tokens_with_blanks(text):
    lengths = token_counts.PieceLengths(tokenizer_path("piece_bpe_32k.model"), {"a": 1})
    assert lengths.count(text) == len(lengths.model.encode(text))


def odd_marks(rng):
    """Texts of blanks, marks, special strings, letters of many scripts and words."""
    parts = [" ", "  ", "\n", "\t", "\r\n", "\x1c", "\u3000", "▁", "<s>", "</s>", "<unk>", "<|endoftext|>", "<0x0A>", "it's", "don’t", "Å", "İ", "ß", "ﬁ", "日本", "𝄞", "👩‍👩‍👧", "é", "e\u0301", "12,345.6", "!?", "--", "a", "The", "token", "of", "Straße"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))


def test_tokens_of_random_texts_equal_the_libraries():
    rng = random.Random(6)
    lengths = token_counts.PieceLengths(tokenizer_path("piece_bpe_32k.model"))
    ids = packing.WordIds(tokenizer_path("word_bpe_49k.json"))
    for _ in range(3000):
        text = odd_marks(rng)
        assert lengths.count(text) == len(lengths.model.encode(text)), repr(text)
        assert ids.text(text) == np.array(ids.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


@pytest.mark.parametrize("sampled", [1, 30, 10**6])
def test_frequent_pieces_come_from_a_bounded_sample(docs, sampled):
    found = frequent_pieces(docs, "text", lambda t: t.encode().split(), 2000, sampled=sampled)
    assert len(found) <= 2000 and all(0 < len(p) <= 32 for p in found)
    if sampled > 1000:
        n = Counter(w for _, t, *_ in corpus() for w in (t or "").encode().split())
        assert found == sorted((w for w in n if len(w) <= 32), key=lambda w: (-n[w], w))


def test_equal_rows_are_packed_in_bounded_groups(spark):
    same = spark.createDataFrame([(None, 0, 0, 700, 5)] * 1000, "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(same, 2048, per_group=100).collect()
    assert len(rows) == 1000 and len({r.sequence_id for r in rows}) == 500
    assert {r.least_sequences for r in rows} == {500}


def test_certificate_holds_over_all_groups(spark):
    rng = np.random.default_rng(9)
    sizes = np.minimum(rng.geometric(1 / 300, 20_000), 2048)
    pieces = spark.createDataFrame([(i, 0, 0, int(n), i) for i, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(pieces, 2048, per_group=500).collect()
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert len(rows) == 20_000 and max(used.values()) <= 2048
    assert rows[0].least_sequences == packing.lower_bound(sizes, 2048)
    assert len(used) <= rows[0].least_sequences + 3 < len({r.sequence_id for r in packing.pack(pieces, 2048, per_group=500, rounds=0).collect()})


def test_fingerprints_equal_plain_votes(spark, docs):
    def plain(text):
        found = text.encode().split()
        votes = np.zeros(64, int)
        for a, b in zip(found, [*found[1:], None]):
            h = xxhash.xxh64_intdigest(a, 42)
            h = xxhash.xxh64_intdigest(b, h) if b is not None else h
            votes += [(h >> k & 1) * 2 - 1 for k in range(64)]
        return sum(1 << k for k in range(64) if votes[k] > 0)

    got = {r.doc_id: r.fingerprint for r in simhash.fingerprint_report(docs).collect()}
    assert got == {i: f"{plain(t or ''):016x}" for i, t, *_ in corpus()}


@pytest.mark.parametrize("text", ["İstanbul it's", "Σας, 12ab", "x<|endoftext|>y", "a b\x1cc", "Éa!! o'x", "ﬁ ㎏", ""])
def test_word_ids_equal_the_tokenizer(text):
    ids = packing.WordIds(tokenizer_path("word_bpe_49k.json"))
    assert ids.text(text) == np.array(ids.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_is_whole_and_tight(spark, docs, empty):
    pieces = packing.document_pieces(docs, tokenizer_path("word_bpe_49k.json"), 512)
    rows = packing.pack(pieces, 512, per_group=20).collect()
    ids = packing.WordIds(tokenizer_path("word_bpe_49k.json"))
    want = {}
    for i, t, *_ in corpus():
        raw = ids.text(t or "") + b"\0\0\0\0"
        for k in range(0, len(raw), 2048):
            want[i, k // 2048] = (k // 4, len(raw[k : k + 2048]) // 4, zlib.crc32(raw[k : k + 2048]))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    by = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    least = packing.lower_bound(np.array([r.length for r in rows]), 512)
    assert max(by.values()) <= 512 and len(by) <= least + 5
    assert packing.pack_documents(empty, tokenizer_path("word_bpe_49k.json")).count() == 0


def test_lower_bound_never_exceeds_a_packing():
    rng = np.random.default_rng(1)
    for _ in range(50):
        sizes = np.sort(rng.integers(1, 65, rng.integers(1, 60)))[::-1]
        bins, offsets = packing.best_fit_decreasing(sizes, 64)
        assert packing.lower_bound(sizes, 64) <= bins.max() + 1 and (offsets + sizes <= 64).all()
    assert packing.lower_bound(np.array([33] * 7), 64) == 7


@pytest.mark.parametrize("limits", [{}, {"bucket_limit": 1}, {"spread": 1}, {"spread": 0}])
@pytest.mark.parametrize("tasks", [1, 5])
def test_repeats_equal_brute_force(docs, limits, tasks):
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs.coalesce(tasks), **limits).collect()}
    words = {i: (t or "").encode().split() for i, t, *_ in corpus()}
    starts = {}
    for i, w in words.items():
        for s in range(len(w) - 34):
            starts.setdefault(tuple(w[s : s + 35]), []).append((i, s))
    gone = {(i, s + k) for found in starts.values() if len(found) > 1 for i, s in found for k in range(35)}
    for i, w in words.items():
        kept = [x for k, x in enumerate(w) if (i, k) not in gone]
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())


@pytest.mark.parametrize("limits", [{}, {"cluster_nodes": 2, "block": 2}, {"block_bytes": 2_000, "block": 5}])
def test_components_equal_brute_force(docs, limits):
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(docs, **limits).collect()}
    sets = {}
    for i, t, *_ in corpus():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0:
                    comp[a] = comp[b] = min(comp[a], comp[b])
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), comp[i]) for i in sets}


@pytest.mark.parametrize("limits", [{}, {"block": 40}, {"cluster_nodes": 10, "block": 7}])
def test_chains_and_families_across_blocks(spark, limits):
    """A family of near copies, a chain of which only neighbours are linked, and copies under null ids."""
    rng = random.Random(21)
    fresh = iter(f"w{i}" for i in range(10**6))
    base = [next(fresh) for _ in range(300)]
    texts = []
    for _ in range(120):  # most are alike, all share bands
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(300)] = next(fresh)
        texts.append(" ".join(copy))
    chain = [next(fresh) for _ in range(400)]
    for _ in range(60):
        texts.append(" ".join(chain))
        chain = chain[30:] + [next(fresh) for _ in range(30)]
    rows = [(None if i % 7 == 3 else i, t) for i, t in enumerate(texts)] + [(None, texts[0])] * 50 + [(900 + i, texts[0].upper()) for i in range(50)] + [(7, None), (None, None), (8, " ")]
    got = minhash_dedup.components(spark.createDataFrame(rows, "doc_id long, text string"), **limits).collect()
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)))
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if comp[i] != comp[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) > 0:
                comp = [comp[j] if c == comp[i] else c for c in comp]
    least = {c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=None) for c in set(comp)}
    want = sorted(((rows[i][0] or -1, len(sets[i]), least[comp[i]] if least[comp[i]] is not None else -1) for i in range(len(rows))))
    assert sorted(((r.doc_id or -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in got)) == want


def test_hot_keys_lose_no_rows(spark):
    rows = spark.range(20_000).selectExpr("if(id < 8000, 0, id % 5000) AS k", "id AS v")
    facts = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top")).where("k % 2 = 0")
    got = join_hot(rows, facts, "k").agg(F.count("*").alias("n"), F.sum(F.col("v") * F.col("top")).alias("s")).first()
    assert got == rows.join(facts, "k").agg(F.count("*").alias("n"), F.sum(F.col("v") * F.col("top")).alias("s")).first()
    assert join_hot(rows, facts, "k", "left_semi").count() == rows.join(facts, "k", "left_semi").count()


def test_components_of_a_star(spark):
    links = [(i, 5000) for i in range(1, 3000)] + [(5001, i) for i in range(6000, 8000)] + [(3000, 6000)]
    found = {r.node: r.comp for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {n: 1 if n <= 5000 and n != 3000 else 3000 for link in links for n in link}


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r.node: r.comp for r in connected_components(links).collect()}
    assert found == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}


def test_secrets_equal_plain_patterns(docs, empty):
    got = {r.doc_id: r for r in secret_scan.scan_report(docs).collect()}
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, t, *_ in corpus():
        base = [(m.start(), 0, m.end()) for m in assign.finditer(t or "") if len(m[2]) >= 6]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 24]
        said = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(base))
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert sum(r.n_entropy for r in got.values()) == 1
    assert secret_scan.redact(empty).count() == 0
    clean = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    assert clean[0] is None and not any("hunter22" in (t or "") or "8fJ2kQ" in (t or "") for t in clean.values())


def test_entropy_of_windows(spark):
    text = "aAbBcC0123456789zzzzzzzzzzQ"
    got = spark.range(1).select(secret_scan.highest_entropy(secret_scan.F.lit(text), 8).alias("h")).first().h
    h = lambda w: -sum(w.count(c) / 8 * math.log2(w.count(c) / 8) for c in set(w))
    assert abs(got - max(h(text[i : i + 8]) for i in range(len(text) - 7))) < 1e-9


def test_fingerprints(spark, docs, empty):
    got = {r.doc_id: r for r in simhash.fingerprint_report(docs).collect()}
    rows = sorted(corpus())
    far = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    for k, (i, t, *_) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + (nxt[1] or "")[:cut]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].near_next == 1 - far(got[i].fingerprint, got[nxt[0]].fingerprint) / 64
    assert got[5].fingerprint == got[6].fingerprint
    assert got[0].n_near == sum(far(got[0].fingerprint, r.fingerprint) <= 3 for r in got.values()) - 1
    assert simhash.fingerprint_report(empty).count() == 0


def test_radius_search_equals_all_pairs(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(20)]
    prints = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (2**63 - 1) for b in base * 4})
    table = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {(r.fp, r.other) for r in simhash.within_radius(table, table).collect()}
    assert got == {(a, b) for a in prints for b in prints if bin(a ^ b).count("1") <= 3}


def plain_figures(text):
    found = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    again = sum(x in lines[:i] for i, x in enumerate(lines))
    windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return len(found), sum(map(len, found)), len(re.findall("[#*$%&|<>]", text or "")), again, len(covered)


def test_quality_figures_equal_plain_counts(spark):
    rng = random.Random(12)
    part = ["a", "bc", "d e f g h", "Ééé", "日本", "\x1c", "\xa0", "\u2028", "#", "*$%&|<>", "\n", "\n\n", " ", "\t", "\x0b", "\x0c", "\r\n", "line of words", "x\ud7ff"]
    texts = [None, "", " ", "\n"] + ["".join(rng.choice(part) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.quality_rules(rows, keep=["doc_id"]).collect()}
    for i, t in enumerate(texts):
        r, (n, chars, symbols, again, repeats) = got[i], plain_figures(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, again, repeats), repr(t)
        assert r.base_failed == (n < 10 or 100 * repeats > 20 * n) and r.kept == (not r.base_failed and r.p_good >= 0.5)


def test_quality_against_labels(spark):
    at = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{at}/labels.parquet").select("doc_id", "quality")
    kept = quality_rules.quality_rules(spark.read.parquet(f"{at}/documents.parquet"), keep=["doc_id"])
    rows = kept.join(labels, "doc_id").select("kept", "quality").collect()
    good, bad = ([r.kept for r in rows if r.quality == k] for k in (1, 0))
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.05 * len(bad) and len(bad) > 20


def test_share_and_rates_are_estimated():
    n = 100_000
    rng = np.random.default_rng(2)
    for share in (0.2, 0.5, 0.9):
        good = rng.random(n) < share
        says = lambda on_good, on_bad, c: np.where(rng.random(n) < np.where(good, on_good, on_bad), c, "0")
        votes = [says(0.02, 0.6, "-") for _ in range(8)] + [np.where(rng.random(n) < 0.9, np.where(good, "+", "-"), "0") for _ in range(2)]
        patterns = ["".join(p) for p in zip(*votes)]
        p_good = quality_rules.fit(Counter(patterns))
        kept = np.array([p_good[p] >= 0.5 for p in patterns])
        assert (kept == good).mean() > 0.99 and abs(np.mean([p_good[p] for p in patterns]) - share) < 0.01


def test_main_text_on_held_out_pages(spark):
    extractor = html_extract.Extractor(*html_extract.train())
    pages = html_extract.labelled_pages(100, seed=77)
    right = [a == b for blocks, labels in pages for a, b in zip(extractor.labels(blocks), labels)]
    assert sum(right) >= 0.98 * len(right)
    rows = [(1, None), (2, ""), (3, "<nav><a href=x>Go</a></nav><article><h1>A &amp; b</h1><p>One  two\nthree.<p>Four &lt;five&gt;.</article><footer>&copy; x</footer>"), (4, "<p")]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id int, html string")).collect()}
    assert got == {1: "", 2: "", 3: "A & b\nOne two three.\nFour <five>.", 4: ""}


def test_licenses_and_mixture_on_odd_tables(docs, empty):
    got = {r.doc_id: r for r in license_scan.with_licenses(docs).collect()}
    assert [i for i, r in got.items() if r.n_licenses] == [max(got)] and got[max(got)].license == "MIT"
    assert source_mixing.mixed_sizes(empty).count() == 0
    mixed = source_mixing.mixed_sizes(docs, budget_share=2.0, max_epochs=2, weights={"domain": {"d0": 1, "d1": 0}})
    assert {r.domain for r in mixed.select("domain").distinct().collect()} == {"d0", "d2", "d3"}


WHOLE = sorted({name: text for name, text in sorted(license_scan.TEMPLATES, key=lambda t: len(t[1]))}.items())


@pytest.mark.parametrize("name, text", [pytest.param(*t, id=t[0]) for t in WHOLE if len(t[1].split()) > 60])
def test_whole_licences_alone_and_inside_prose(spark, name, text):
    """The longest template of each licence as it is, wrapped at other places, and between other paragraphs."""
    rng = random.Random(name)
    prose = lambda: " ".join("".join(rng.choice("etaoinsr") for _ in range(rng.randint(3, 8))) for _ in range(60)) + "."
    wrapped = "\n".join(textwrap.wrap(text, 71))
    inside = f"{prose()}\n\n{prose()}\n\nCopyright (c) 2020 Some Author\n\n{wrapped}\n\n{prose()}"
    rows = spark.createDataFrame(list(enumerate([text, wrapped, inside, prose(), text[: len(text) // 4]])), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.with_licenses(rows).collect()}
    for i in (0, 1, 2):
        assert name in (got[i].licenses or "").split(","), (name, i, got[i].licenses)
    assert got[3].n_licenses == 0


def test_licences_in_a_text_of_a_megabyte(spark):
    line = "some words that tell you of the use of this software and its terms\n"
    text = line * 8_000 + "Released under the MIT License.\n" + line * 8_000
    got = license_scan.with_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.licenses == "MIT"


def test_pipeline_stages(spark, docs, empty):
    kept = corpus_pipeline.STAGES[0][1](spark, docs, "")
    once = corpus_pipeline.STAGES[1][1](spark, kept, "")
    assert once.columns == docs.columns and once.count() < kept.count() < docs.count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
