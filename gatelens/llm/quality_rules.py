"""Quality rules by weak supervision: rules vote or abstain, EM estimates how often each is right, documents are kept
by their posterior probability of being good.

Each rule looks at one figure of a text and votes good (+), bad (-) or abstains (0). Documents with the same votes are
alike to the model, so all of them are counted by vote pattern (at most 2 ** 8 * 3 ** 2 patterns, whatever the table's
size) and EM runs on the counts, estimating the share of good documents and how often each rule votes rightly, wrongly or not at
all on good and on bad ones.

Words are ``[^\\x20\\x09-\\x0D]+``. A null or empty text has no words and fails the base rule. Texts are read whole. Repeated
rows count as often as they occur; ties (posterior equal to the threshold) are kept. Columns named like a result are
replaced, other extra columns stay. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, written

SYMBOLS = b"#*$%&|<>"
#: A rule's figure, the bound from which it votes bad, and, for the two rules that can also vote for a document, the
#: bound from which it votes good. In the first eight a high figure is bad, in the last two a high figure is good.
BAD_FROM = {"symbols_per_word": 0.25, "repeated_share": 0.20, "duplicate_line_share": 0.30, "capital_share": 0.50, "shouts_per_word": 0.30, "bar_line_share": 0.50, "word_length_off": 6.5, "repeated_word_share": 0.90}
BAD_TO_GOOD_FROM = {"plain_word_share": (0.50, 0.80), "sentence_line_share": (0.05, 0.60)}
RULES = [*BAD_FROM, *BAD_TO_GOOD_FROM]
#: One of these after a word's letters leaves it plain.
MARKS = ".,;:!?"
COLUMNS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, votes string"


def repeated_words(found: list[bytes], width: int = 5) -> int:
    """Words covered by a window of ``width`` words that occurs twice or more in the text."""
    windows = list(zip(*(found[i:] for i in range(width))))
    if len(set(windows)) == len(windows):
        return 0
    seen, twice = set(), set()
    for w in windows:
        (twice if w in seen else seen).add(w)
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if w in twice:
            covered += i + width - max(i, end)
            end = i + width
    return covered


def base_figures(text: str) -> tuple[int, int, int, int, int, list[bytes]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the words."""
    raw = text.encode()
    found = raw.split()
    chars = len(text) - sum(map(raw.count, (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")))
    symbols = sum(raw.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(found), chars, symbols, len(lines) - len(set(lines)), repeated_words(found), found


def votes(text: str, figures: tuple) -> str:
    n, chars, symbols, dup_lines, repeats, found = figures
    if not n:
        return "0" * len(RULES)
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    bare = text
    for mark in MARKS:
        bare = bare.replace(mark + " ", " ").replace(mark + "\n", "\n")
    of_words = bare[:-1].split() if bare[-1:] in MARKS else bare.split()
    k = max(1, len(of_words))
    high_is_bad = (
        symbols / n,
        repeats / n,
        dup_lines / max(1, len(lines)),
        sum(map(str.isupper, of_words)) / k if n >= 5 else 0,
        text.count("!!") / n,
        sum(" | " in x for x in lines) / max(1, len(lines)),
        abs(chars / n - 5.5),
        1 - len(set(found)) / n,
    )
    high_is_good = (
        sum(map(str.isalpha, of_words)) / k,
        sum(x[-1] in ".!?…。\"»”" and " | " not in x for x in lines) / max(1, len(lines)),
    )
    bad = "".join("-" if v >= at else "0" for v, at in zip(high_is_bad, BAD_FROM.values()))
    return bad + "".join("+" if v >= good else "-" if v <= bad_to else "0" for v, (bad_to, good) in zip(high_is_good, BAD_TO_GOOD_FROM.values()))


def with_votes(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds the base figures, base_failed and the vote pattern."""

    def make():
        def each(texts: list) -> list[pa.Array]:
            rows = []
            for text in texts:
                f = base_figures(text or "")
                rows.append((*f[:5], f[0] < 10 or 100 * f[4] > 20 * f[0], votes(text or "", f)))
            columns = list(zip(*rows)) or [()] * 7
            return [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 5 + [pa.bool_(), pa.string()])]

        return each

    return add_columns(df, text_col, keep, COLUMNS, make)


def fit(patterns: dict[str, int], rounds: int = 200, prior: tuple[float, float] = (8.0, 2.0)) -> dict[str, float]:
    """Posterior probability of good for each vote pattern, from counts of patterns over all documents.

    The share of good documents and, for each rule, how often it votes rightly, wrongly or abstains on good and on bad documents
    are estimated in turns with the posteriors: most rules only ever vote bad, so their accuracy is that they abstain on good
    documents and vote on bad ones, and an abstention counts little where the rule seldom votes. prior: pseudo-votes right and
    wrong of each rule on each class, as many abstentions as both, together weighted by a hundredth of the documents, so that their
    part stays the same as tables grow. A vote never speaks for the class that it is against, and the share stays between a
    twentieth and nineteen, so that the classes can't change places."""
    if not patterns:
        return {}
    names = sorted(patterns)
    n = np.array([patterns[p] for p in names], float)
    cast = np.array([[["-0+".index(c) == k for k in range(3)] for c in p] for p in names], float)  # pattern, rule, vote
    can = cast.any(0)  # votes that a rule has cast at all
    right, wrong = (x / sum(prior) / 2 for x in prior)
    expected = np.array([[right, 0.5, wrong], [wrong, 0.5, right]])  # of bad, good documents
    pseudo = np.where(can, expected[:, None, :], 0) * max(1.0, n.sum() / 100)
    good = 1 / (1 + np.exp(-1.4 * (cast[:, :, 2] - cast[:, :, 0]).sum(1)))
    for _ in range(rounds):
        rates = np.einsum("cp,pjk->cjk", np.stack([n * (1 - good), n * good]), cast) + pseudo
        rates /= rates.sum(2, keepdims=True)
        says = np.log(np.where(can, rates[1], 1) / np.where(can, rates[0], 1))
        says[:, 0], says[:, 2] = np.minimum(says[:, 0], 0), np.maximum(says[:, 2], 0)
        share = np.clip(n @ good / n.sum(), 0.05, 0.95)
        new = 1 / (1 + np.exp(-(np.log(share / (1 - share)) + np.einsum("pjk,jk->p", cast, says))))
        if np.abs(new - good).max() < 1e-12:
            break
        good = new
    return dict(zip(names, np.round(good, 9).tolist()))


def quality_rules(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """``keep`` (None: all columns), base figures, base_failed, votes, p_good double and kept boolean.
    Columns of the table that have such names are replaced.

    Vote patterns are counted over all rows before any is decided; texts are never shuffled. Rows that do not keep the text as a
    column are written once with their votes and read twice, others are voted on twice."""
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("p_good", "kept")]
    rows = with_votes(df, text_col, keep)
    if text_col not in rows.columns:
        rows = written(rows, "votes")
    counts = (rows if text_col not in rows.columns else with_votes(df, text_col, [])).groupBy("votes").count().collect()  # at most 2304 rows
    p_good = fit({r["votes"]: r["count"] for r in counts})
    scores = df.sparkSession.createDataFrame(sorted(p_good.items()), "votes string, p_good double")
    out = rows.join(F.broadcast(scores), "votes", "left")
    first = [c for c in rows.columns if c.lower() not in ("votes", "p_good", "kept")]
    return out.select(*[F.col(f"`{c}`") for c in first], "votes", "p_good", (~F.col("base_failed") & (F.col("p_good") >= threshold)).alias("kept"))
