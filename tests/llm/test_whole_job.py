"""Inputs on which operators once did less than the whole job."""

import re
import textwrap

import pytest

import corpus_pipeline
from gatelens.llm import html_extract, license_scan, minhash_dedup, secret_scan
from gatelens.llm.license_texts import TEMPLATES


@pytest.mark.parametrize(
    "page, texts",
    [
        ("<p>one<svg viewBox='0 0 1 1'/><p>two<p>three", ["one", "two", "three"]),
        ("<svg><text>drawn</text></svg><p>one<svg><path d=''><p>two", ["one", "two"]),
        ("<svg-icon name=x></svg-icon><p>one</p><template-card><p>two</p></template-card>", ["one", "two"]),
        ("<html><head><title>T</title><meta charset=utf8><script>'<div>'</script><body><p>one", ["one"]),
        ("<head><title>T</title><style>p {}</style><p>one</p>", ["one"]),
        ("<head><title>T</title><script>'<div>'</script> loose </head><p>one", ["one"]),
        ("<p>one</p>if a < b then c", ["one", "if a < b then c"]),
        ("a < b and c <a hre", ["a < b and c"]),
    ],
)
def test_blocks_lose_no_text(page, texts):
    assert [text for _, text, _ in html_extract.blocks_of(page)] == texts


KEYS = ["key-3ax6xnjp29jd6fds4gc373sgvjxteol0", "3ax6xnjp29jd6fds4gc373sgvjxteol0", "JBSWY3DPEHPK3PXPJBSWY3DPEHPK3PXP", "SEED_MZXW6YTBOI2GC3TEN5WUQ7LK", "key-9f86d081884c7d659a2f", "id/9F86D081884C7D659A2F"]
CLEAN = ["how-to-build-3-data-pipelines-in-2024", "top10-things-to-see-in-paris", "covid19vaccinationrates", "img/photo20231105/interior", "internationalization2024", "REQUIREMENTSDOCUMENT2024", "11111111112222222222", "zyzy12zyzy12zyzy12zyzy12"]


def test_single_case_keys_beside_slugs(spark):
    docs = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(KEYS + CLEAN)], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in secret_scan.scan_report(docs).collect()}
    assert [spans[i] for i in range(len(spans))] == [f"entropy:4:{4 + len(k)}" for k in KEYS] + [""] * len(CLEAN)
    assert {r.text for r in secret_scan.redact(docs).where(f"doc_id < {len(KEYS)}").collect()} == {"see [REDACTED] there"}


def test_near_copies_under_null_and_repeated_ids(spark):
    base = [f"w{i}" for i in range(120)]
    near = lambda k: " ".join([*base[k:], *(f"t{i}" for i in range(k))])
    other = lambda k: " ".join([f"v{i}" for i in range(100)] + ["end"] * k)
    spread = "  ".join(base)  # the same words, another text
    rows = [(None, near(0)), (None, near(2)), (None, spread), (7, "quite another text"), (None, other(0)), (9, other(1)), (9, near(4)), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=repr)
    assert [r for r in kept if r[1]] == sorted([(7, "quite another text"), (9, other(1)), (9, near(4))], key=repr)
    without = docs.where("doc_id IS NULL")
    assert sorted(len(r.text or "") > 0 for r in corpus_pipeline.near_duplicates(spark, without, "").collect())[-2:] == [True, True]
    marks = minhash_dedup.near_duplicates(without).collect()
    assert not any(r.kept for r in marks) and all(r.component_id is None for r in marks)
    again = spark.createDataFrame([(1, near(0)), (1, near(0) + " x"), (2, near(2))], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(again).collect()) == [(1, 1, True), (1, 1, True), (2, 1, False)]
    # a null row is the only link between two others
    chain = [(1, near(0)), (None, near(9)), (2, near(18))]
    ids = {r.doc_id: (r.component_id, r.kept) for r in minhash_dedup.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string")).collect()}
    assert ids == {1: (1, True), None: (1, False), 2: (1, False)}


def test_notices_of_several_paragraphs_between_prose(spark):
    long = {name: text for name, text in TEMPLATES if len(text) > 300}
    prose = "\n\n".join(f"A paragraph of the report with number n{i}. It t{i} tells t{i} of w{i} the work a{i} and b{i} of its c{i} use d{i} in town e{i}." for i in range(12))
    broken = lambda text: re.sub(r"(: 1\.|[.:]) (?=[A-Z1-9])", r"\1\n\n", text)
    wrapped = lambda text: "\n".join(textwrap.wrap(text, 60))
    rows = [(name, str(how is broken), f"{prose}\n{how(text)}\n{prose}") for name, text in long.items() for how in (broken, wrapped)]
    rows += [("", "prose", prose), ("MIT", "one paragraph", f"{prose}\n\n{long['MIT']}\n\n{prose}")]
    got = license_scan.with_licenses(spark.createDataFrame(rows, "want string, how string, text string"), keep=["want", "how"]).collect()
    assert {(r.want, r.how): r.license or "" for r in got} == {(w, h): w for w, h, _ in rows}
    assert all((r.n_licenses > 0) == (r.want != "") and (not r.want or r.dice >= 0.8) for r in got), got


def test_names_and_numbers_of_licences_in_one_text(spark):
    whole = {name: text for name, text in TEMPLATES if len(text) > 5_000}
    prose = "\n".join(f"A line of the report with number n{i} tells t{i} of w{i} and of things a{i} and b{i} in town e{i}." for i in range(150))
    end = "\n".join(whole["GPL-2.0"].split("\n")[100:103])
    head = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version.\n\nThis {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details.\n"
    cases = [
        (f"{prose}\n{whole['GPL-2.0']}\n{prose}", "GPL-2.0", 1),
        (f"{prose}\n{whole['GPL-2.0']}\n{prose}\n{end}", "GPL-2.0", 1),
        (f"{whole['GPL-2.0']}\n{prose}\n{whole['GPL-2.0']}", "GPL-2.0", 2),
        (f"{whole['MPL-2.0']}\n{prose}\n{whole['GPL-2.0']}", "GPL-2.0,MPL-2.0", 2),
        (f"{whole['MPL-2.0']}\n{whole['Apache-2.0']}", "Apache-2.0,MPL-2.0", 3),  # the short notice at the end of Apache-2.0 is a unit of its own, once
        (f"{whole['Apache-2.0']}\n{whole['Apache-2.0']}\n{prose}", "Apache-2.0", 3),
        (prose + "\n\n" + head.format("program", "", "2") + "\n" + prose, "GPL-2.0", 1),
        (prose + "\n\n" + head.format("library", "Lesser ", "2.1") + "\n" + prose, "LGPL-2.1", 1),
        (prose + "\n\n" + head.format("program", "", "3") + "\n" + prose, "GPL-3.0", 1),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "id long, text string")
    got = {r.id: (r.licenses, r.n_licenses) for r in license_scan.with_licenses(df, keep=["id"]).collect()}
    assert {i: got[i] for i in got} == {i: (names, n) for i, (_, names, n) in enumerate(cases)}
