"""Licence scans in column expressions: normalised text against licence templates by the Dice coefficient of the sets of
neighbouring word pairs.

A text's units are the whole text, its paragraphs (between blank lines), its lines and its sentences, each once, and runs of
neighbouring pieces (sentences, cut at line ends too) that neither hold nor lie in a unit which matches by itself. So a notice of several paragraphs, lines or
sentences is found between other text; one that begins or ends inside a piece is not. Of runs that overlap the one that shares most pairs
with its template counts, then the most alike; a run has at most three times the words that the upper bound allows pairs. For a template of
more than LONG pairs the runs are those from one strong piece (half of its pairs are the template's) to another with no more than a 50th, an 8th or half of
the template's pairs between two of them; they also end before a piece that is their first one once more, so copies in a row are told apart. Runs are looked for
only where a text has as many of a template's pairs as a match needs. The SQL has no runs: rows with such a notice differ. Normalised: lower case, letters and digits kept, everything
else one space. A template is compared only with units whose number of pairs lies within the bounds that the threshold
leaves: 2 min / (a + b) >= t. Texts without any anchor word have no match at all: anchors are chosen so that the
pairs of a template without an anchor are too few to reach the threshold, and this is checked for every template.

A null or empty text has no match. Texts are read whole. Equal scores: the licence first by name. Repeated rows are
each scanned. Columns named like a result are replaced, extra columns stay. An empty table gives an empty result.
No shuffle; templates are literals of the plan, their number and size fixed by the caller.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, scan
from .license_texts import TEMPLATES

#: Common words that would let nearly every text pass as anchors.
COMMON = frozenset("a above all an and any are as at be but by can copies do for form free from has have hope if in into is it list may met mit more must no not of on one or other out related sa see should so source such terms that the this to under use used was will with without work you".split())
#: Pairs from which a template is long; parts of it that may lie between two of a long run's strong pieces.
LONG = 400
GAPS = (50, 8, 2)
PARTS = ("n_licenses", "license", "dice", "licenses")


def normal_words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def pairs_of(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def least_shared(pairs: int, threshold: float) -> int:
    """Pairs that any unit must share with a template to reach the threshold: it has threshold / (2 - threshold) of its size."""
    smallest = math.ceil(round(threshold / (2 - threshold) * pairs, 9))
    return math.ceil(round(threshold * (pairs + smallest) / 2, 9))


def anchors(templates: list[tuple[str, str]], threshold: float) -> list[str]:
    """Words of which every unit that matches a template has at least one."""
    chosen: set[str] = set()
    for _, text in sorted(templates, key=lambda t: len(t[1])):
        pairs = [p.split() for p in pairs_of(normal_words(text))]
        need = least_shared(len(pairs), threshold)
        while len(open_pairs := [p for p in pairs if not chosen.intersection(p)]) >= need:
            found = Counter(w for p in open_pairs for w in set(p) if w not in COMMON)
            if not found:
                raise ValueError(f"no anchor words left for: {text[:60]}")
            # long words first: they are rarer in other texts
            found = next(f for size in (7, 5, 1) if (f := {w: n for w, n in found.items() if len(w) >= size}))
            chosen.add(min(found, key=lambda w: (-found[w], -len(w), w)))
    return sorted(chosen)


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _units(text: Column) -> Column:
    lines = F.split(text, "\n")
    sentences = F.split(F.regexp_replace(text, r"([.!?])[\x20\x09-\x0D]+", "$1\n"), "\n")
    paragraphs = F.split(text, r"\n[\x20\x09-\x0D]*\n")
    normal = F.transform(F.concat(F.array(text), paragraphs, lines, sentences), _normal)
    return F.array_distinct(F.filter(normal, lambda u: u.contains(" ")))


def _pairs(unit: Column) -> Column:
    pairs = lambda words: F.transform(words, lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))
    return F.array_distinct(F.filter(let(F.split(unit, " "), pairs), lambda p: p.isNotNull()))


def _pieces(text: Column, matched: Column) -> Column:
    """Normalised pieces in order; a unit among ``matched`` is one bar, which no run crosses."""
    unless = lambda unit, inner: F.when(F.array_contains(matched, _normal(unit)), F.array(F.lit("|"))).otherwise(inner)
    sentences = lambda line: F.flatten(F.transform(F.split(F.regexp_replace(line, r"([.!?])[\x20\x09-\x0D]+", "$1\n"), "\n"), lambda u: unless(u, F.array(_normal(u)))))
    lines = lambda part: F.flatten(F.transform(F.split(part, "\n"), lambda u: unless(u, sentences(u))))
    paragraphs = F.flatten(F.transform(F.split(text, r"\n[\x20\x09-\x0D]*\n"), lambda u: unless(u, lines(u))))
    return F.filter(unless(text, paragraphs), lambda u: u != "")


def _sums(numbers: Column) -> Column:
    """0, then the sum of the numbers up to each."""
    return F.concat(F.array(F.lit(0)), scan(numbers, lambda a, b: a + b))


def _listed(pairs: list[str]) -> Column:
    """The pairs, letters, digits and one space each, as a literal array of the plan."""
    return F.split(F.lit("|".join(pairs)), r"\|")


def _runs(pieces: Column, wanted: Column, threshold: float) -> Column:
    """(minus shared, worse, name, first, last) of runs of two pieces or more that match, none overlapping a better one."""
    pairs = F.transform(pieces, lambda p, i: F.transform(F.split(p, " "), lambda w, k: F.concat(w, F.lit(" "), F.coalesce(F.get(F.split(p, " "), k + 1), F.get(F.split(F.get(pieces, i + 1), " "), F.lit(0)), F.lit("|")))))

    def of_template(t: Column, listed: Column, size: Column) -> Column:
        hits = F.transform(listed, lambda ps: F.size(F.array_intersect(ps, t["pairs"])))
        last = F.size(pieces) - 1

        def with_sums(h: Column) -> Column:
            hit, bar = h["hit"], h["bar"]
            between = lambda sums, i, j: F.get(sums, j + 1) - F.get(sums, i)
            fits = lambda i, j: (between(size, i, j) <= t["most"]) & (between(hit, i, j) >= t["need"]) & (between(bar, i, j) == 0)
            run = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
            starts = F.filter(F.sequence(F.lit(0), last - 1), lambda i: between(hit, i, i) > 0)

            def runs_of(at: Column, part: int, again: bool) -> Column:
                """Strong pieces in a row, with no more other pairs between two of them than this part of the template's; ``again``: one
                that is the first of its run once more begins another."""

                def step(held: Column, x: Column) -> Column:
                    return let(F.get(held, F.size(held) - 1), lambda last: F.when(joins(last, x), F.concat(F.slice(held, F.lit(1), F.size(held) - 1), F.array(run(last["i"], x)))).otherwise(F.concat(held, F.array(run(x, x)))))

                def joins(last: Column, x: Column) -> Column:
                    close = F.get(size, x) - F.get(size, last["j"] + 1) <= F.size(t["pairs"]) / part
                    return F.coalesce(close & (F.get(pieces, x) != F.get(pieces, last["i"])) if again else close, F.lit(False))

                return F.aggregate(at, F.expr("cast(array() as array<struct<i:int,j:int>>)"), step)

            # a piece has a word at least, which bounds how far a run may go
            short = lambda i: F.transform(F.filter(F.sequence(i + 1, F.least(last, i + t["most"])), lambda j: fits(i, j)), lambda j: run(i, j))
            strong = F.filter(F.sequence(F.lit(0), last), lambda i: (between(hit, i, i) * 2 >= between(size, i, i)) & (between(size, i, i) > 2))
            clusters = let(strong, lambda at: F.array_distinct(F.flatten(F.array(*[runs_of(at, part, again) for part in GAPS for again in (False, True)]))))
            whole = F.filter(clusters, lambda r: (r["i"] < r["j"]) & fits(r["i"], r["j"]))
            found = F.when(t["long"], whole).otherwise(F.flatten(F.transform(starts, short)))

            def scored(r: Column) -> Column:
                flat = F.flatten(F.slice(listed, r["i"] + 1, r["j"] - r["i"] + 1))
                unit = F.array_distinct(F.slice(flat, F.lit(1), F.size(flat) - 1))  # without the pair that leads out of the run
                return let(unit, lambda u: let(F.size(F.array_intersect(u, t["pairs"])), lambda n: F.struct((-n).alias("shared"), (F.lit(-2.0) * n / (F.size(u) + F.size(t["pairs"]))).alias("worse"), t["name"].alias("name"), r["i"].alias("i"), r["j"].alias("j"))))

            return F.filter(F.transform(found, scored), lambda r: r["worse"] <= -threshold)

        return let(F.struct(_sums(hits).alias("hit"), _sums(F.transform(pieces, lambda p: (p == "|").cast("int"))).alias("bar")), with_sums)

    every = let(pairs, lambda listed: let(_sums(F.transform(listed, F.size)), lambda size: F.flatten(F.transform(wanted, lambda t: of_template(t, listed, size)))))
    none = F.expr("cast(array() as array<struct<shared:int,worse:double,name:string,i:int,j:int>>)")
    free = lambda kept, r: ~F.exists(kept, lambda k: (k["i"] <= r["j"]) & (r["i"] <= k["j"]))
    chosen = F.aggregate(F.array_sort(every), none, lambda kept, r: F.when(free(kept, r), F.concat(kept, F.array(r))).otherwise(kept))
    return F.when((F.size(wanted) > 0) & (F.size(pieces) > 1), chosen).otherwise(none)


def with_licenses(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """``keep`` (None: all columns), n_licenses long (units that match a template), license string (the best one's name, null if
    none), dice double (its score) and licenses string (all names, sorted, comma-joined)."""
    kept = [F.col(f"`{c}`") for c in (df.columns if keep is None else keep) if c.lower() not in PARTS and not c.startswith("__")]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    sized = [(name, pairs_of(normal_words(t))) for name, t in templates]
    low = min(math.ceil(round(threshold / (2 - threshold) * len(p), 9)) for _, p in sized)
    high = max(math.floor(round((2 - threshold) / threshold * len(p), 9)) for _, p in sized)
    of_short, of_long = ([t for t, (_, p) in zip(templates, sized) if (len(p) > LONG) == is_long] for is_long in (False, True))
    least_long = min([math.ceil(round(threshold / (2 - threshold) * len(p), 9)) for _, p in sized if len(p) > LONG], default=0)

    def has_anchor(unit: Column) -> Column:
        """Whether it has a word that a match needs; words of long templates count in texts that are long enough for one."""
        # anchors are ASCII, so cutting at other letters too can only let a text pass, never stop one
        of = lambda words, some: F.arrays_overlap(words, F.lit(anchors(some, threshold)).cast("array<string>"))
        return let(F.split(unit, "[^a-z0-9]+"), lambda words: of(words, of_short) | ((F.size(words) > least_long) & of(words, of_long)))

    empty = F.expr("cast(array() as array<string>)")
    rows = df.select(*kept, text.alias("__t"))
    rows = rows.select(*kept, "__t", F.when(has_anchor(F.lower("__t")), F.filter(_units(F.col("__t")), has_anchor)).otherwise(empty).alias("__units"))
    # words of a unit bound its distinct pairs from above only, so the pairs decide about the lower bound again
    sized_units = F.filter(F.transform("__units", lambda u: F.struct(u.alias("unit"), _pairs(u).alias("pairs"))), lambda p: F.size(p["pairs"]).between(low, high))
    rows = rows.select(*kept, "__t", (F.size("__units") > 0).alias("__any"), sized_units.alias("__pairs"))

    def best(unit: Column) -> Column:
        scores = []
        for name, pairs in sized:
            n = F.size(unit)
            within = (n >= threshold / (2 - threshold) * len(pairs) - 1e-9) & (n <= (2 - threshold) / threshold * len(pairs) + 1e-9)
            dice = F.lit(2.0) * F.size(F.array_intersect(unit, _listed(pairs))) / (n + F.lit(len(pairs)))
            scores.append(F.when(within, F.struct((-dice).alias("worse"), F.lit(name).alias("name"))))
        return F.array_min(F.array_compact(F.array(*scores)))

    alone = F.filter(F.transform("__pairs", lambda p: let(best(p["pairs"]), lambda b: F.struct(b["worse"].alias("worse"), b["name"].alias("name"), p["unit"].alias("unit")))), lambda s: s["worse"] <= -threshold)
    most = lambda pairs: 3 * math.floor(round((2 - threshold) / threshold * len(pairs), 9))
    template = lambda name, p: F.struct(F.lit(name).alias("name"), _listed(p).alias("pairs"), F.lit(least_shared(len(p), threshold)).alias("need"), F.lit(most(p)).alias("most"), F.lit(len(p) > LONG).alias("long"))
    searched = F.array(*[template(name, p) for name, p in sized])
    wanted = let(_pairs(_normal(F.col("__t"))), lambda have: F.filter(searched, lambda t: (F.size(have) >= t["need"]) & (F.size(F.array_intersect(have, t["pairs"])) >= t["need"])))
    rows = rows.select(*kept, "__t", alone.alias("__alone"), F.when(F.col("__any"), wanted).otherwise(F.filter(searched, lambda t: F.lit(False))).alias("__wanted"))
    pieces = F.when(F.size("__wanted") > 0, _pieces(F.col("__t"), F.transform("__alone", lambda s: s["unit"]))).otherwise(empty)
    rows = rows.select(*kept, "__alone", "__wanted", pieces.alias("__pieces"))
    rows = rows.select(*kept, "__alone", _runs(F.col("__pieces"), F.col("__wanted"), threshold).alias("__runs"))
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["worse"].alias("worse"), s["name"].alias("name")))
    rows = rows.select(*kept, F.concat(plain("__alone"), plain("__runs")).alias("__found"))
    found = F.col("__found")
    top = F.array_min(found)
    return rows.select(*kept, F.size(found).cast("long").alias("n_licenses"), top["name"].alias("license"), (-top["worse"]).alias("dice"), F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda s: s["name"]))), ",").alias("licenses"))


def oracle_sql(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> str:
    """DuckDB SQL for the rows over ``documents``: every unit against every template, without anchors or size bounds."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quote(name)}, [{', '.join(map(quote, pairs_of(normal_words(t))))}])" for name, t in templates)
    return f"""
WITH templates(name, pairs) AS (VALUES {values}),
texts AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
units AS (SELECT DISTINCT rid, trim(regexp_replace(lower(u), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS unit FROM (
  SELECT rid, unnest(list_concat([text], regexp_split_to_array(text, '\\n[ \\t\\n\\x0B\\f\\r]*\\n'), string_split(text, chr(10)),
    string_split(regexp_replace(text, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(10), 'g'), chr(10)))) AS u FROM texts)),
pairs AS (SELECT rid, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pairs
  FROM (SELECT rid, unit, string_split(unit, ' ') AS w FROM units) WHERE len(w) > 1),
scored AS (SELECT rid, unit, name, 2.0::DOUBLE * len(list_intersect(p.pairs, t.pairs)) / (len(p.pairs) + len(t.pairs)) AS dice
  FROM pairs p, templates t
  WHERE len(p.pairs) BETWEEN len(t.pairs) / 2.0 AND len(t.pairs) * 2.0),
best AS (SELECT rid, unit, max(dice) AS dice, arg_min(name, (-dice, name)) AS name FROM scored GROUP BY rid, unit HAVING max(dice) >= {threshold}),
found AS (SELECT rid, count(*) AS n_licenses, arg_min(name, (-dice, name)) AS license, max(dice) AS dice, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses FROM best GROUP BY rid)
SELECT doc_id, coalesce(n_licenses, 0)::BIGINT AS n_licenses, license, dice, coalesce(licenses, '') AS licenses
FROM texts LEFT JOIN found USING (rid)"""
