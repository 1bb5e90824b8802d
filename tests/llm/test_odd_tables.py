"""Every operator and stage on rows with nulls in any column, repeated rows and extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gatelens.llm import html_extract, license_scan, minhash_dedup, packing, quality_rules, secret_scan, simhash, source_mixing, substring_dedup, token_counts
from gatelens.llm.queries import tokenizer_path

PROSE = " ".join(f"word{i % 83}x{i % 7}" for i in range(90))
ROWS = [
    (None, None, None, None, None),
    (None, PROSE, "en", None, 3),
    (None, PROSE, "en", None, 3),
    (1, None, None, "src1", None),
    (2, "", "de", "src2", 0),
    (3, " \n\t ", "", "", 0),
    (4, PROSE, "en", "src1", 9),
    (4, PROSE, "en", "src1", 9),
    (4, "another text under the same id", None, "src2", 9),
    (5, PROSE + " tail", "fr", "src3", 9),
    (6, "é" * 40_000 + ' token="abcdef99" ' + "0a" * 13, "es", "elsewhere", None),
    (7, "日 本 " * 3_000, "en", "src1", 1),
]
#: Names that operators use for columns of their own, in results or on the way.
CLASHING = "n_words N_Removed Kept spans d h node low comp component_id sig bands fp bucket rn n_near n_tokens domain epoch row cut full key part piece start length grp bin gap secret_spans license dice votes p_good base_failed kept_id document copy __spans __t a.b".split()
MODEL, VOCABULARY = "piece_bpe_32k.model", "word_bpe_49k.json"

OPERATORS = {
    "mixing": lambda df: source_mixing.mixed_sizes(df),
    "repeats": lambda df: substring_dedup.remove_repeats(df),
    "packing": lambda df: packing.pack_documents(df, tokenizer_path(VOCABULARY)),
    "fingerprints": lambda df: simhash.fingerprint_report(df),
    "near_duplicates": lambda df: minhash_dedup.near_duplicates(df),
    "secrets": lambda df: secret_scan.scan_report(df),
    "token_counts": lambda df: token_counts.token_counts(df, tokenizer_path(MODEL), keep=["doc_id"]),
    "main_text": lambda df: html_extract.main_text(df.withColumnRenamed("text", "html"), keep=["doc_id"]),
    "quality": lambda df: quality_rules.quality_rules(df, keep=["doc_id"]),
    "licenses": lambda df: license_scan.with_licenses(df, keep=["doc_id"]),
}


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def crowded(plain):
    return plain.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHING])


def rows(df):
    return sorted(repr(r.asDict(recursive=True)) for r in df.drop("sequence_id", "offset", "sequence_length").collect())


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_extra_columns_change_nothing_and_rows_stay_whole(plain, crowded, name):
    want = rows(OPERATORS[name](plain))
    assert rows(OPERATORS[name](crowded)) == want
    if name == "packing":
        want = [r for r in want if "'piece': 0" in r]
    if name != "mixing":  # its rows are epochs
        assert len(want) == len(ROWS)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(plain, name):
    assert OPERATORS[name](plain.limit(0)).count() == 0


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_keep_extra_columns(spark, plain, crowded, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    got = run(spark, crowded, "")
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert got.columns == crowded.columns
        assert all(r[c] == f"extra {c}" for r in got.collect() for c in CLASHING)
        got = got.select(plain.columns)
    assert rows(got) == rows(run(spark, plain, ""))


def test_rows_under_null_and_equal_ids(plain):
    repeats = [(r.doc_id, r.n_words, r.n_removed) for r in OPERATORS["repeats"](plain).collect()]
    assert sorted(repeats, key=str)[-3:] == [(None, 0, 0), (None, 90, 90), (None, 90, 90)]
    assert (4, 6, 0) in repeats and repeats.count((4, 90, 90)) == 2 and (5, 91, 90) in repeats
    near = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in OPERATORS["near_duplicates"](plain).collect()}
    assert near[1, 0] == (1, True) and near[5, 87] == (4, False)
    counted = {(r.doc_id, r.n_tokens) for r in OPERATORS["token_counts"](plain).collect()}
    assert {(None, 0), (1, 0), (2, 0)} <= counted
