"""Mixing sources to target weights: a token budget goes down a tree (domain, language, source), and every leaf takes the
prefix of its seeded epochs that its share allows.

A node's budget is shared among its children by weight. A child can take at most what its leaves hold in ``max_epochs``
epochs; what it can't take goes to its siblings by their weights, and only what all of them can't take is left for
their ancestors' other children, since no node is ever given more than its leaves hold. The shares of one family follow from prefix sums over
the children ordered by capacity for each unit of weight.

A leaf with T tokens and a share A takes floor(A / T) whole epochs; of the next epoch it takes documents in the order of
md5(doc_id:seed:epoch) while those before hold fewer tokens than are left, so it passes its share by less than one
document. The cut is found from sums over 4,096 hash ranges of the leaf and then inside one range, so no leaf is ever sorted or
gathered as a whole; documents are then chosen by comparing their hash with the leaf's cut, without a shuffle of texts.

Tokens are words ``[^\\x20\\x09-\\x0D]+``. Null texts have none; null parts of a path are the branch ``unknown``. Nodes without a
weight have weight 1; weight 0 takes nothing. Documents without tokens go with the hash order like others; leaves without tokens
take nothing. Rows that share an id stay together. Extra columns are kept. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BLANKS, written

LEVELS = ("domain", "lang", "source")
#: Target weights of the registered query: level -> name -> weight; other names have weight 1.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 6, "de": 2, "fr": 1, "es": 1}, "source": {}}
RANGES = 3  # hexadecimal digits of the hash ranges


def domain_of(source: Column) -> Column:
    """Sources src0, src1, ... belong to four domains by turns."""
    return F.concat(F.lit("d"), F.pmod(F.regexp_extract(source, r"(\d+)$", 1).try_cast("int"), F.lit(4)).cast("string"))


def epoch_key(doc_id: Column, seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(str(seed)), epoch.cast("string")).cast("binary"))


def token_sizes(df: DataFrame, domain: Column) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens."""
    text = F.btrim(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    size = F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, BLANKS))).cast("long")
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), *leaf_columns(domain), size.alias("n_tokens"))


def leaf_columns(domain: Column) -> list[Column]:
    named = lambda c, n: F.coalesce(c.cast("string"), F.lit("unknown")).alias(n)
    return [named(domain, "domain"), named(F.col("lang"), "lang"), named(F.col("source"), "source")]


def _weight(level: str, weights: dict) -> Column:
    out = F.lit(1.0)
    for name, w in sorted(weights.get(level, {}).items()):
        out = F.when(F.col(level) == name, F.lit(float(w))).otherwise(out)
    return out


def share_out(nodes: DataFrame, family: list[str], level: str, weights: dict) -> DataFrame:
    """Adds ``share``: each child's part of its family's ``budget``; children have ``cap``, their family the columns ``family``."""
    nodes = nodes.withColumn("w", _weight(level, weights)).where("w > 0").withColumn("ratio", F.col("cap") / F.col("w"))
    order = W.partitionBy(*family).orderBy("ratio", level)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    nodes = nodes.withColumn("level_at", (F.col("budget") - before) / rest)
    whole = W.partitionBy(*family).orderBy("ratio", level).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level_of = F.first(F.when(F.col("ratio") > F.col("level_at"), F.col("level_at")), ignorenulls=True).over(whole)
    nodes = nodes.withColumn("per_weight", level_of)
    return nodes.withColumn("share", F.when(F.col("per_weight").isNull() | (F.col("ratio") <= F.col("per_weight")), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("per_weight"))).drop("w", "ratio", "level_at", "per_weight")


def leaf_plan(sizes: DataFrame, budget_share: float, max_epochs: int, weights: dict) -> DataFrame:
    """domain, lang, source, full (whole epochs), rest (tokens of the next epoch) for every leaf with tokens and weight."""
    positive = F.lit(True)
    for level in LEVELS:
        positive = positive & (_weight(level, weights) > 0)
    leaves = sizes.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    total = leaves.agg(F.sum("tokens").alias("all_tokens"))
    leaves = leaves.where(positive & (F.col("tokens") > 0)).withColumn("cap", F.col("tokens") * max_epochs)
    top = leaves.groupBy("domain").agg(F.sum("cap").alias("cap"))
    root = top.agg(F.sum("cap").alias("root_cap"))
    one = total.join(F.broadcast(root)).select(F.least(F.floor(F.col("all_tokens") * F.lit(budget_share)).cast("double"), F.col("root_cap").cast("double")).alias("budget"))
    shares = share_out(top.join(F.broadcast(one)), ["budget"], "domain", weights).select("domain", F.col("share").alias("budget"))
    mid = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(shares, "domain")
    shares = share_out(mid, ["domain"], "lang", weights).select("domain", "lang", F.col("share").alias("budget"))
    low = share_out(leaves.join(shares, ["domain", "lang"]), ["domain", "lang"], "source", weights)
    goal = F.floor(F.col("share") + 1e-6).cast("long")
    return low.select(*LEVELS, F.floor(goal / F.col("tokens")).cast("int").alias("full"), (goal - F.floor(goal / F.col("tokens")).cast("long") * F.col("tokens")).alias("rest"))


def leaf_cuts(sizes: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """The plan with ``cut``: documents of the partial epoch are those whose key is at most it (null: none)."""
    keyed = sizes.join(plan.where("rest > 0"), list(LEVELS)).withColumn("key", epoch_key(F.col("doc_id"), seed, F.col("full"))).withColumn("part", F.substring("key", 1, RANGES))
    parts = keyed.groupBy(*LEVELS, "part", "rest").agg(F.sum("n_tokens").alias("n"))
    below = F.coalesce(F.sum("n").over(W.partitionBy(*LEVELS).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = parts.withColumn("below", below).where("below < rest").groupBy(*LEVELS).agg(F.max(F.struct("part", "below")).alias("at")).select(*LEVELS, "at.part", "at.below")
    inside = keyed.join(at, [*LEVELS, "part"]).groupBy(*LEVELS, "part", "below", "rest", "key").agg(F.sum("n_tokens").alias("n"))
    sofar = F.col("below") + F.coalesce(F.sum("n").over(W.partitionBy(*LEVELS).orderBy("key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cuts = inside.withColumn("sofar", sofar).where("sofar < rest").groupBy(*LEVELS).agg(F.max("key").alias("cut"))
    return plan.join(cuts, list(LEVELS), "left").select(*LEVELS, "full", "cut")


def take(rows: DataFrame, cuts: DataFrame, seed: int) -> DataFrame:
    """``rows`` (with doc_id and the leaf columns) once for each epoch that takes them, with ``epoch``."""
    last = F.col("cut").isNotNull() & (epoch_key(F.col("doc_id"), seed, F.col("full")) <= F.col("cut"))
    epochs = F.col("full") + F.when(last, 1).otherwise(0)
    chosen = rows.join(cuts, list(LEVELS)).withColumn("epochs", epochs).where("epochs > 0")
    return chosen.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1))).drop("full", "cut", "epochs")


def mixed_sizes(df: DataFrame, domain: Column | None = None, budget_share: float = 0.6, max_epochs: int = 3, weights: dict = WEIGHTS, seed: int = 7) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, epoch: a row for each document and epoch of the mixture."""
    sizes = written(token_sizes(df, domain_of(F.col("source")) if domain is None else domain), "sizes")
    cuts = written(leaf_cuts(sizes, leaf_plan(sizes, budget_share, max_epochs, weights), seed), "cuts")
    return take(sizes, cuts, seed).select("doc_id", *LEVELS, "n_tokens", "epoch")


def mix(df: DataFrame, domain: Column | None = None, budget_share: float = 0.6, max_epochs: int = 3, weights: dict = WEIGHTS, seed: int = 7) -> DataFrame:
    """The rows of the mixture with the columns of ``df``; a document comes once for each epoch that takes it."""
    domain = domain_of(F.col("source")) if domain is None else domain
    sizes = written(token_sizes(df, domain), "sizes")
    cuts = written(leaf_cuts(sizes, leaf_plan(sizes, budget_share, max_epochs, weights), seed), "cuts")
    d, la, so = leaf_columns(domain)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), d, la, so)
    return take(rows, cuts, seed).select("row.*")


def _case(level: str, column: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{n}' THEN {float(w)}::DOUBLE" for n, w in sorted(WEIGHTS[level].items())) + " ELSE 1.0::DOUBLE END" if WEIGHTS[level] else "1.0::DOUBLE"


def oracle_sql(budget_share: float = 0.6, max_epochs: int = 3, seed: int = 7) -> str:
    """DuckDB SQL for mixed_sizes over ``documents``."""

    def shared(source: str, family: str, level: str) -> str:
        order = f"PARTITION BY {family} ORDER BY ratio, {level}"
        return f"""SELECT *, CASE WHEN per_weight IS NULL OR ratio <= per_weight THEN cap::DOUBLE ELSE w * per_weight END AS share FROM (
  SELECT *, first_value(CASE WHEN ratio > level_at THEN level_at END IGNORE NULLS) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS per_weight FROM (
  SELECT *, (budget - coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level_at FROM (
  SELECT *, cap / w AS ratio FROM (SELECT *, {_case(level, level)} AS w FROM {source}))))"""

    return f"""
WITH sizes AS (SELECT doc_id, coalesce('d' || (TRY_CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) % 4)::VARCHAR, 'unknown') AS domain, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
  len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''))::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT * {max_epochs} AS cap FROM sizes GROUP BY ALL HAVING sum(n_tokens) > 0),
one AS (SELECT least(floor((SELECT sum(n_tokens) FROM sizes)::DOUBLE * {budget_share}::DOUBLE), sum(cap)::DOUBLE) AS budget FROM leaves),
a AS (SELECT domain, sum(cap)::DOUBLE AS cap, budget FROM leaves, one GROUP BY ALL),
a2 AS ({shared('a', 'budget', 'domain')}),
b AS (SELECT domain, lang, sum(l.cap)::DOUBLE AS cap, any_value(a2.share) AS budget FROM leaves l JOIN a2 USING (domain) GROUP BY ALL),
b2 AS ({shared('b', 'domain', 'lang')}),
c AS (SELECT domain, lang, source, tokens, l.cap::DOUBLE AS cap, b2.share AS budget FROM leaves l JOIN b2 USING (domain, lang)),
c2 AS ({shared('c', 'domain, lang', 'source')}),
plan AS (SELECT domain, lang, source, (floor(share + 1e-6)::BIGINT // tokens)::INT AS full_epochs, floor(share + 1e-6)::BIGINT % tokens AS rest FROM c2),
keyed AS (SELECT s.*, full_epochs, rest, md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), '{seed}', full_epochs::VARCHAR)) AS key FROM sizes s JOIN plan USING (domain, lang, source)),
summed AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE UNBOUNDED PRECEDING EXCLUDE GROUP), 0) AS sofar FROM keyed)
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(full_epochs + CASE WHEN sofar < rest THEN 1 ELSE 0 END))::INT AS epoch FROM summed"""
