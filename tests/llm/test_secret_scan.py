"""Entropy spans against a plain sliding window, and texts of a megabyte."""

import math
import random
import re
from collections import Counter

import pytest

from gatelens.llm import secret_scan

LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
CLASSES = {"hex": "abcdef" + DIGITS, "lower": LETTERS + DIGITS, "upper": LETTERS.upper() + "234567", "mixed": LETTERS + LETTERS.upper() + DIGITS, "letters": LETTERS + LETTERS.upper(), "base64": LETTERS + LETTERS.upper() + DIGITS + "+/"}
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
LIMITS = dict(hex=3.0, mixed=3.7, letters=3.8, lower=3.3, upper=3.2)


def plain_entropy(unit):
    sums = [sum(c * math.log2(c) for c in Counter(unit[i : i + 20]).values()) for i in range(len(unit) - 19)]
    return math.log2(20) - min(sums) / 20


def plain_class(unit):
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", unit) and re.search("[0-9]", unit) and re.search("[a-fA-F]", unit):
        return "hex"
    if re.search("[a-z]", unit) and re.search("[A-Z]", unit):
        if re.search("[0-9+]", unit):
            return "mixed"
        return "letters" if re.fullmatch("[A-Za-z]+", unit) and re.search("[a-z][A-Z]+[a-z]+[A-Z]+[a-z]+[A-Z]+[a-z]+[A-Z]", unit) else None
    if re.fullmatch("[a-z0-9]+", unit) and re.search("[a-z][0-9]+[a-z]+[0-9]|[0-9][a-z]+[0-9]+[a-z]", unit):
        return "lower"
    return "upper" if re.fullmatch("[A-Z0-9]+", unit) and re.search("[A-Z][0-9]+[A-Z]|[0-9][A-Z]+[0-9]", unit) else None


def plain_spans(text):
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    added = []
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        parts = re.split("[-_/]", m[0])
        slug = len(parts) > 1 and re.fullmatch("[A-Za-z]*", parts[0]) and all(re.fullmatch("[A-Za-z]*|[0-9]+", p) for p in parts)
        harmless = re.search(r"(?i)example|placeholder|changeme|your|dummy|xxxx|test[-_]?key|abcdefgh|12345678", m[0])
        if slug or harmless or any(s < m.end() and m.start() < e for s, _, e in base):
            continue
        units = [m[0], *(p for p in re.split("[-+/_=]+", m[0]) if len(p) >= 20)]
        if any((k := plain_class(u)) and plain_entropy(u) >= LIMITS[k] for u in units):
            added.append((m.start(), 3, m.end()))
    return sorted(base + added)


def odd_texts(n=400, seed=4):
    rng = random.Random(seed)
    key = lambda k, c: "".join(rng.choice(CLASSES[c]) for _ in range(k))
    piece = [
        lambda: key(rng.randint(18, 60), rng.choice([*CLASSES])),
        lambda: rng.choice(["password=", "api_key: ", "token = '", "secret\":\""]) + key(rng.randint(3, 30), "mixed"),
        lambda: "AKIA" + key(rng.randint(12, 20), "upper"),
        lambda: "-".join(rng.choice(["some", "words", "2024", "x9", "Path"]) for _ in range(rng.randint(2, 9))),
        lambda: "/".join(key(rng.randint(2, 25), "mixed") for _ in range(3)),
        lambda: "sk-live_" + key(24, rng.choice([*CLASSES])) + "-" + key(8, "lower"),
        lambda: "getUserNameFromRequestOrSession" + rng.choice(["", "Test"]),
        lambda: rng.choice("é日𝄞 \n\t.,") * rng.randint(1, 3),
        lambda: rng.choice("-_=/") * rng.randint(15, 60),
        lambda: " ".join("".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 9))) for _ in range(5)),
    ]
    return [rng.choice(["", " ", " ", "\n"]).join(rng.choice(piece)() for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_spans_equal_a_plain_scan(spark):
    texts = odd_texts()
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secret_scan.scan_report(rows).collect()}
    want = {i: plain_spans(t) for i, t in enumerate(texts)}
    assert got == {i: ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in spans) for i, spans in want.items()}
    assert sum(k == 3 for spans in want.values() for _, k, _ in spans) > 100
    masked = {r.doc_id: r.text for r in secret_scan.redact(rows).collect()}
    for i, t in enumerate(texts):
        out, end = "", 0
        for s, _, e in want[i]:
            if s >= end:
                out += t[end:s] + "[REDACTED]"
            end = max(end, e)
        assert masked[i] == out + t[end:]


def planted():
    rng = random.Random(8)
    key = lambda k, c="mixed": "".join(rng.choice(CLASSES[c].replace("x", "")) for _ in range(k))
    yield "ruler of dashes", "-" * 10**6, 0
    yield "ruler of lines", "_" * 10**6, 0
    yield "slashes", "a/" * 500_000, 0
    yield "equals", "=" * 10**6, 0
    yield "one candidate", "k " + "".join(c for c in key(10**6) if c not in "1y"), 1
    yield "many candidates", " ".join(key(24) for _ in range(50_000)), None
    yield "many of all kinds", " ".join(key(24) if i % 2 else "password=" + key(10) for i in range(50_000)), None
    yield "words in one", "/".join(["abc"] * 250_000), 0


@pytest.mark.parametrize("name, text, n", [pytest.param(*row, id=row[0]) for row in planted()])
def test_texts_of_a_megabyte(spark, name, text, n):
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = secret_scan.scan_report(rows).first()
    assert got.n_entropy == n if n is not None else 24_000 < got.n_entropy + got.n_assign <= 50_000
    masked = secret_scan.redact(rows).first().text
    assert masked.count("[REDACTED]") == got.n_entropy + got.n_assign and (n or masked == text or n is None)


@pytest.mark.parametrize("kind", [*CLASSES])
def test_planted_keys_of_each_class(spark, kind):
    rng = random.Random(kind)
    # a hexadecimal key of 24 or more is a base span
    keys = ["".join(rng.choice(CLASSES[kind].replace("+", "").replace("/", "")) for _ in range(22 if kind == "hex" else 40)) for _ in range(100)]
    rows = spark.createDataFrame([(i, f"use {k} here") for i, k in enumerate(keys)], "doc_id long, text string")
    assert sum(r.n_entropy for r in secret_scan.scan_report(rows).collect()) >= 97


def test_clean_slugs(spark):
    slugs = ["how-to-use-this-page-2024-01-15", "internationalization", "src/main/java/org/Some/Thing", "getElementsByClassName", "snake_case_names_in_code_0", "MAX_RETRY_COUNT_PER_HOST", "2024-01-15-12-30-45-2024", "--------------------------", "https://a.b/some/long/path/to/page"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(slugs)], "doc_id long, text string")
    assert [r.spans for r in secret_scan.scan_report(rows).collect() if r.spans] == []


def test_a_placeholder_lets_go_its_own_part_only(spark):
    key = "Q7dK2mZp9LxT4vBn8RsW3yHc"
    texts = [f"{key}-12345678-q", f"example-{key}", key, "example-api-key-12345678-abcdefgh", "exampleQ7dK2mZp9LxT4vBn8RsW3"]
    rows = secret_scan.scan_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.n_entropy for r in rows.collect()} == {0: 1, 1: 1, 2: 1, 3: 0, 4: 0}
