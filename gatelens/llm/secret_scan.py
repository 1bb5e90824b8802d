"""Secret scans in column expressions: three fixed patterns, and strings whose characters are too evenly spread.

Strings of 20 or more token characters are candidates. A window slides over each, and over each of its parts between
separators that fills a window. The counts of the characters in the window stand in the lanes of a few longs; a step adds
one to the lane of the character that enters and takes one from that of the one that leaves, and changes the sum of
c log2 c by these two alone. A candidate is a span of kind ``entropy`` if the most even window of it or of a part reaches the
Shannon entropy that its class of characters asks for, unless the allow-list matches what was judged or a pattern's span overlaps it.

Classes: hexadecimal; letters of both cases with digits or plus signs (base64); letters of both cases alone; lower-case
letters and digits, upper-case letters and digits (base36, base32). Words with numbers are told from single-case keys by how often
letters and digits take turns: three times in lower case, twice in upper case; words run together are told from keys of letters by
how often a lower-case letter meets an upper-case one: four times. Of random keys of 20 characters 2 to 3 percent have fewer turns, of 32
less than 0.3. Letters of a single case are never a key, and a single-case key cut by separators into parts of less than a window is not found.

A null text is empty: no spans. Texts of any length are scanned whole, in time that grows with the length, or with n log n for
n matches; no pattern repeats a group, so none recurses on a long match. Spans that start together are ordered as the
kinds are listed. Repeated rows are scanned each on its own. Columns named like a result are replaced, all other
extra columns stay. An empty table gives an empty result. There is no shuffle, no Python and nothing grows but with a text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import POWERS, let, scan

#: The base patterns with the least length of the part that counts.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SEPARATORS = "[-+/_=]+"
#: What marks a high-entropy string as harmless: placeholders, alphabets in order, paths and slugs of plain words and numbers.
PLACEHOLDER = r"(?i)example|placeholder|changeme|your[-_]?|dummy|xxxx|test[-_]?key|abcdefgh|12345678"
SLUG, NO_SLUG = "[-_/]", "[+=]|[A-Za-z][0-9]|[0-9][A-Za-z]|^[0-9]"
TURNS_LOWER = "[a-z][0-9]+[a-z]+[0-9]|[0-9][a-z]+[0-9]+[a-z]"
TURNS_UPPER = "[A-Z][0-9]+[A-Z]|[0-9][A-Z]+[0-9]"
TURNS_CASE = "[a-z][A-Z]+[a-z]+[A-Z]+[a-z]+[A-Z]+[a-z]+[A-Z]"
#: A lane holds counts up to LANE - 1, a long has LANES of them; entropies are compared as whole numbers of 1 / SCALE bits.
LANE_BITS, LANES, SCALE = 5, 12, 1 << 40

SPAN = "struct<start:int,end:int>"


def _none(of: str) -> Column:
    return F.expr(f"cast(array() as array<{of}>)")


def _found(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of a pattern's leftmost matches, in code points: what is between the matches and
    the matches themselves, laid end to end."""

    def placed(parts: Column) -> Column:
        ends = scan(F.transform(parts, lambda p: p["skip"] + p["long"]), lambda a, b: a + b)
        return F.zip_with(parts, ends, lambda p, end: F.struct((end - p["long"]).alias("start"), end.alias("end"), p["match"].alias("match")))

    match, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    part = lambda m, b: F.struct(F.length(b).alias("skip"), F.length(m).alias("long"), m.alias("match"))
    parts = let(match, lambda found: F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), part))
    return F.when(text.rlike(pattern), let(parts, placed)).otherwise(_none("struct<start:int,end:int,match:string>"))


def _lanes() -> tuple[Column, Column, Column]:
    """For each ASCII code the long of its lane, the lane's shift and one in that lane."""
    at = {ord(c): divmod(i, LANES) for i, c in enumerate(ALPHABET)}
    shift = {c: LANE_BITS * lane for c, (_, lane) in at.items()}
    literal = lambda values, kind: F.lit(values).cast(f"array<{kind}>")
    codes = range(128)
    return (
        literal([at[c][0] if c in at else -1 for c in codes], "int"),
        literal([shift.get(c, 0) for c in codes], "int"),
        literal([1 << shift[c] if c in at else 0 for c in codes], "bigint"),
    )


def least_plog(candidate: Column, window: int) -> Column:
    """The smallest sum of c log2 c, in 1 / SCALE, of the character counts c of any ``window`` characters in a row; null if there
    are fewer. Characters are those of ALPHABET. The sums are whole numbers, so none drifts however long the candidate is."""
    if window >= 1 << LANE_BITS:
        raise ValueError(f"a window has less than {1 << LANE_BITS} characters")
    word, shift, one = _lanes()
    plog = [round(c * math.log2(c) * SCALE) if c else 0 for c in range(window + 1)]
    # what a character adds that makes its count c + 1
    grows = F.lit([b - a for a, b in zip(plog, plog[1:])]).cast("array<bigint>")
    n_words = -(-len(ALPHABET) // LANES)

    def step(s: Column, x: Column) -> Column:
        into, out_of = x["into"], x["out_of"]
        count = lambda c: F.call_function("shiftright", F.get(s["words"], F.get(word, c)), F.get(shift, c)).bitwiseAND(F.lit((1 << LANE_BITS) - 1)).cast("int")
        leaves = out_of >= 0
        change = lambda w, c: F.when(F.get(word, c) == w, F.get(one, c)).otherwise(F.lit(0).cast("bigint"))
        words = F.transform(s["words"], lambda v, w: v + change(w, into) - F.when(leaves, change(w, out_of)).otherwise(F.lit(0).cast("bigint")))
        less = F.when(leaves, F.get(grows, count(out_of) - 1)).otherwise(F.lit(0).cast("bigint"))
        more = F.get(grows, count(into) - (into == out_of).cast("int"))
        total = s["total"] - less + more
        best = F.when(s["i"] + 1 >= window, F.least(s["best"], total)).otherwise(s["best"])
        return F.struct((s["i"] + 1).alias("i"), words.alias("words"), total.alias("total"), best.alias("best"))

    def slid(codes: Column) -> Column:
        late = F.concat(F.array_repeat(F.lit(-1), window), F.slice(codes, F.lit(1), F.greatest(F.size(codes) - window, F.lit(0))))
        moves = F.zip_with(codes, late, lambda a, b: F.struct(a.alias("into"), b.alias("out_of")))
        moves = F.filter(moves, lambda m: m["into"].isNotNull())
        start = F.struct(F.lit(0).alias("i"), F.array_repeat(F.lit(0).cast("bigint"), n_words).alias("words"), F.lit(0).cast("bigint").alias("total"), F.lit(None).cast("bigint").alias("best"))
        return F.aggregate(moves, start, step, lambda s: s["best"])

    return let(F.transform(F.split(candidate, ""), F.ascii), slid)


def highest_entropy(candidate: Column, window: int) -> Column:
    """The largest Shannon entropy, in bits, of any ``window`` characters in a row; null if there are fewer."""
    return F.lit(math.log2(window)) - least_plog(candidate, window) / F.lit(float(SCALE * window))


def suspicious(candidate: Column, window: int = 20, hex_bits: float = 3.0, mixed_bits: float = 3.7, letter_bits: float = 3.8, lower_bits: float = 3.3, upper_bits: float = 3.2) -> Column:
    """True for a candidate that a class's threshold finds, in it or in a part, and the allow-list does not let go."""
    slug = candidate.rlike(SLUG) & ~candidate.rlike(NO_SLUG)
    most = lambda bits: F.lit(int((math.log2(window) - bits) * window * SCALE)).cast("bigint")

    def judged(unit: Column) -> Column:
        is_hex = unit.rlike("^[0-9a-f]+$|^[0-9A-F]+$") & unit.rlike("[0-9]") & unit.rlike("[a-fA-F]")
        both_cases = unit.rlike("[a-z]") & unit.rlike("[A-Z]")
        is_mixed = both_cases & unit.rlike("[0-9+]")
        is_letters = both_cases & unit.rlike("^[A-Za-z]+$") & unit.rlike(TURNS_CASE)
        is_lower = unit.rlike("^[a-z0-9]+$") & unit.rlike(TURNS_LOWER)
        is_upper = unit.rlike("^[A-Z0-9]+$") & unit.rlike(TURNS_UPPER)
        limit = F.when(is_hex, most(hex_bits)).when(is_mixed, most(mixed_bits)).when(is_letters, most(letter_bits)).when(is_lower, most(lower_bits)).when(is_upper, most(upper_bits))
        return let(limit, lambda at: F.when(at.isNull(), F.lit(False)).otherwise(least_plog(unit, window) <= at))

    # a placeholder lets go the part that it stands in and what is judged as one with it, not a key that is glued to it
    parts = F.filter(F.split(candidate, SEPARATORS), lambda p: F.length(p) >= window)
    units = F.filter(F.array_distinct(F.concat(F.array(candidate), parts)), lambda u: ~u.rlike(PLACEHOLDER))
    return F.when(slug, F.lit(False)).otherwise(F.exists(units, judged))


def _free(candidates: Column, base: Column) -> Column:
    """Candidates that no base span overlaps: of the base spans that start before a candidate's end, found by halving, none ends
    after its start."""

    def among(b: Column) -> Column:
        def starts_before(end: Column) -> Column:
            reach = lambda at, far: F.when(F.coalesce(F.get(b["start"], at + far - 1) < end, F.lit(False)), at + far).otherwise(at)
            fit = F.filter(F.lit(POWERS[::-1]), lambda far: far <= F.size(b["start"]))
            return F.aggregate(fit, F.lit(0), reach)

        return F.filter(candidates, lambda c: F.coalesce(F.get(b["end"], starts_before(c["end"]) - 1) <= c["start"], F.lit(True)))

    ends = scan(F.transform(base, lambda s: s["end"]), F.greatest)
    bounds = F.struct(F.transform(base, lambda s: s["start"]).alias("start"), ends.alias("end"))
    return F.when((F.size(candidates) == 0) | (F.size(base) == 0), candidates).otherwise(let(bounds, among))


def with_spans(df: DataFrame, text_col: str = "text", out: str = "secret_spans") -> DataFrame:
    """Adds an array of (start, kind number, end) of all spans, in order, to every row."""
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() != out and not c.startswith("__")]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = df.select(*kept, text.alias("__t"))
    t = F.col("__t")
    values = F.when(t.rlike(ASSIGN), F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2))).otherwise(_none("string"))
    parts = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "candidates": CANDIDATE}
    rows = rows.select(*kept, values.alias("__values"), *[_found(t, p).alias(f"__{name}") for name, p in parts.items()])

    kind = lambda spans, k: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))
    long_enough = lambda s, v: F.struct(s["start"].alias("start"), F.when(F.length(v) >= ASSIGN_LEAST, s["end"]).alias("end"))
    assign = F.filter(F.zip_with("__assign", "__values", long_enough), lambda s: s["end"].isNotNull())
    base = F.array_sort(F.concat(kind(assign, 0), kind(F.col("__access"), 1), kind(F.col("__hex"), 2)))
    rows = rows.select(*kept, "__candidates", base.alias("__base"))
    added = F.filter(_free(F.col("__candidates"), F.col("__base")), lambda c: suspicious(c["match"]))
    rows = rows.select(*kept, "__base", kind(added, 3).alias("__added"))
    return rows.select(*kept, F.when(F.size("__added") == 0, F.col("__base")).otherwise(F.array_sort(F.concat("__base", "__added"))).alias(out))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.lit(list(KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy: one row per input row."""
    s = F.col("secret_spans")
    count = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long")
    rows = with_spans(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    base = F.sha2(spans_text(F.filter(s, lambda x: x["kind"] < 3)), 256)
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), base.alias("base_sha256"), spans_text(s).alias("spans"), count(3).alias("n_entropy"))


def _masked(text: Column, spans: Column, mark: str) -> Column:
    """The text with ``mark`` for each span; spans that overlap have one mark."""

    def cut(p: Column) -> Column:
        ends, starts, chars = p["ends"], p["starts"], p["chars"]
        until = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
        piece = lambda lo, hi: F.array_join(F.slice(chars, lo + 1, hi - lo), "")
        before = F.transform(starts, lambda start, i: F.when(start >= until(i), F.concat(piece(until(i), start), F.lit(mark))).otherwise(F.lit("")))
        return F.concat(F.array_join(before, ""), let(F.element_at(ends, -1), lambda last: piece(last, F.size(chars))))

    ends = scan(F.transform(spans, lambda s: s["end"]), F.greatest)
    return let(F.struct(ends.alias("ends"), F.transform(spans, lambda s: s["start"]).alias("starts"), F.split(text, "").alias("chars")), cut)


def redact(df: DataFrame, text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """The same rows and columns with every span of the text replaced by ``mark``; null texts stay null."""
    whole = df.select(F.col(f"`{text_col}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    spanned = with_spans(whole, "text", "spans")
    text = F.col("text").cast("string")
    clean = F.when(F.size("spans") > 0, _masked(text, F.col("spans"), mark)).otherwise(text)
    return spanned.select(*[clean.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in df.columns])
