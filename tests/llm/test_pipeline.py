"""The stages of the pipeline, row by row, against plain versions on what the stage before kept."""

import zlib
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from gatelens.llm import packing, quality_rules, source_mixing
from gatelens.llm.queries import tokenizer_path

from .test_operators import DOCS, corpus
from .test_secret_scan import odd_texts, plain_spans

STAGE = dict(corpus_pipeline.STAGES)


def mine():
    """The corpus of the operators' tests, texts with secrets, and repeated and null ids."""
    rows = corpus()
    secret = [f"{t} some words stand before and after every one of these {i}" for i, t in enumerate(odd_texts(80, seed=9))]
    rows += [(1000 + i, t, "en" if i % 3 else "de", f"src{i % 7}", 0) for i, t in enumerate(secret)]
    return rows + [rows[20], (None, rows[21][1], "en", "src1", 0), (None, "text of no id at all", None, None, None)]


@pytest.fixture(scope="module")
def staged(spark):
    """stage -> (its input, its output), each collected; a stage gets what the one before gave."""
    docs, found = spark.createDataFrame(mine(), DOCS), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        rows = out.collect()
        found[name] = (docs.collect(), rows)
        docs = spark.createDataFrame(rows, out.schema)
    return found


def counted(rows):
    return Counter(map(tuple, rows))


def test_quality_rejects_whole_rows_by_its_verdict(spark, staged):
    given, kept = staged["quality rules"]
    numbered = spark.createDataFrame([(i, r.text) for i, r in enumerate(given)], "doc_id long, text string")
    verdict = {r.doc_id: r.kept for r in quality_rules.quality_rules(numbered, keep=["doc_id"]).select("doc_id", "kept").collect()}
    assert 0 < len(kept) < len(given)
    assert counted(kept) == counted(r for i, r in enumerate(given) if verdict[i])
    assert all(len((r.text or "").split()) >= 10 for r in kept)


def test_one_row_of_each_near_group_stays(staged):
    given, kept = staged["near-duplicates"]
    sets = []
    for r in given:
        w = (r.text or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    group = list(range(len(given)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in range(len(given)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0:
                group[top(a)] = top(b)
    members = {}
    for i, r in enumerate(given):
        members.setdefault(top(i), []).append(r)
    late = lambda r: (r.doc_id is None, r.doc_id or 0)
    first = [{tuple(r) for r in rows if late(r) == min(map(late, rows))} for rows in members.values()]
    assert len(kept) == len(first) < len(given)
    assert all(sum(tuple(r) in rows for r in kept) == 1 for rows in first)


def test_secrets_are_cut_out_and_nothing_else(staged):
    given, clean = staged["secret scans"]
    want = []
    for r in given:
        out, at = [], 0
        for start, _, end in plain_spans(r.text):
            if start >= at:
                out += [r.text[at:start], "[REDACTED]"]
            at = max(at, end)
        want.append((r.doc_id, "".join(out) + r.text[at:], *r[2:]))
    assert counted(clean) == Counter(want)
    assert 20 < sum("[REDACTED]" in r.text for r in clean) < len(clean)


def test_mixture_takes_each_document_as_often_as_the_sql(staged):
    given, mixed = staged["mixing sources"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [tuple(r) for r in given])
    taken = con.sql(f"SELECT doc_id, count(*) FROM ({source_mixing.oracle_sql(budget_share=1.0)}) q GROUP BY ALL").fetchall()
    assert Counter(r.doc_id for r in mixed) == Counter(dict(taken))
    assert set(map(tuple, mixed)) <= set(map(tuple, given))


def test_packing_holds_every_piece_once_without_gaps(staged):
    given, packed = staged["packing"]
    ids, want = packing.WordIds(tokenizer_path("word_bpe_49k.json")), Counter()
    for r in given:
        raw = ids.text(r.text or "") + b"\0\0\0\0"
        for k in range(0, len(raw), 8192):
            part = raw[k : k + 8192]
            want[r.doc_id, k // 8192, k // 4, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    room = {}
    for r in sorted(packed, key=lambda r: r.offset):
        assert r.offset == room.get(r.sequence_id, 0)
        room[r.sequence_id] = r.offset + r.length
    assert max(room.values()) <= 2048
