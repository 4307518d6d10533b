"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash.  A source's share of a budget is taken by keeping its
documents up to a hash threshold, so a smaller budget's choice is always a subset of a larger
one's.  The threshold isn't found by sorting: tokens are summed by source and the hash's leading
bits, a running sum over those few buckets finds the one in which the budget runs out, and only
that bucket is split by the next bits, until the hash's bits are used up.

Tokens of a document are those of its text, counted by the encoder of :mod:`.tokens`.  The length
``estimate`` takes ``(n_chars + 3) div 4`` for them, without reading the text; `n_chars` is measured
from the text where it is null.  A null text counts no tokens.

The budget is a stated share of all tokens.  A source that has fewer tokens than its weight asks for
gives all that it has, and the others fill the budget at their weights: source i gives
``min(total_i, level * weight_i)``, at the one level for which these add up to the budget.  So a
source of a few tokens takes nothing from any other.

Defined cases: a null source is a source of its own (shown as null), taken at the default weight;
rows of one doc_id share a hash, hence stay or go together; documents without tokens have no cost
and stay when their hash lies under the threshold; an empty table gives an empty result; other
columns, whatever their names, aren't used here and are passed through by :func:`mixed`.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .hashing import BITS, fresh, id_hash, id_hash_sql
from .tokens import counted

#: Tokens of the text, or characters over four.
LENGTHS = ("tokens", "estimate")


@dataclass(frozen=True)
class Mixture:
    """Relative weight by source and the nested budgets, as parts of the largest one.

    That is `share` of the tokens of all sources of a weight above 0.  Without a share it's the largest
    mixture exactly at the weights, which has min over sources of tokens / weight tokens for each unit of
    weight: a single small source makes it small.
    """

    weights: Mapping[str, float] = field(default_factory=dict)
    default_weight: float = 1.0
    tiers: tuple[float, ...] = (0.25, 0.5, 1.0)
    level_bits: int = 12
    share: float | None = None
    length: str = "estimate"

    def __post_init__(self):
        if self.share is not None and not 0 < self.share <= 1:
            raise ValueError("a share lies in (0, 1]")
        if self.length not in LENGTHS:
            raise ValueError(f"length is one of {LENGTHS}")
        if any(w < 0 for w in self.weights.values()) or self.default_weight < 0:
            raise ValueError("weights can't be negative")
        if list(self.tiers) != sorted(set(self.tiers)) or not all(0 < t <= 1 for t in self.tiers):
            raise ValueError("tiers must rise within (0, 1]")


def estimated() -> Column:
    chars = F.coalesce(F.col("n_chars").cast("bigint"), F.char_length("text").cast("bigint"), F.lit(0).cast("bigint"))
    return F.floor((F.greatest(chars, F.lit(0)) + 3) / 4).cast("bigint")


DOC_TOKENS_SQL = "((greatest(coalesce(n_chars, length(text), 0), 0) + 3) // 4)"


def measured(docs: DataFrame, length: str, *others: Column) -> DataFrame:
    """The columns `others` of `docs`, and `tokens`."""
    if length == "estimate":
        return docs.select(*others, estimated().alias("tokens"))
    return counted(docs.select(*others, "text"), column="tokens")


def slim(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """(doc_id, source, h, tokens): all that the choice depends on, in a few bytes a document."""
    return measured(docs, mixture.length, F.col("doc_id"), F.col("source").cast("string").alias("source"), id_hash(F.col("doc_id")).alias("h"))


def _weight(mixture: Mixture) -> Column:
    found = F.lit(float(mixture.default_weight))
    for name, value in mixture.weights.items():
        found = F.when(F.col("source") == name, F.lit(float(value))).otherwise(found)
    return found


def levels(totals: DataFrame, mixture: Mixture) -> DataFrame:
    """One row: `level<k>`, the tokens for each unit of weight in tier k.

    With sources by rising tokens / weight, the level is the greatest of (budget - tokens of the first
    i) / weight of the others, since a sum of minima is the least of such sums.
    """
    used = totals.where("weight > 0")
    if mixture.share is None:
        unit = F.coalesce(F.min(F.when(F.col("total") > 0, F.col("total") / F.col("weight"))), F.lit(0.0))
        return used.agg(*[(unit * float(t)).alias(f"level{k}") for k, t in enumerate(mixture.tiers)])
    order = Window.orderBy(F.col("total") / F.col("weight"), "source")  # a row a source
    edges = used.select(
        F.coalesce(F.sum("total").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("left"),
    )
    whole = used.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("whole"))
    budget = [F.floor(F.col("whole") * (mixture.share * float(t))) for t in mixture.tiers]
    return edges.crossJoin(F.broadcast(whole)).agg(*[F.coalesce(F.max((b - F.col("before")) / F.col("left")), F.lit(0.0)).alias(f"level{k}") for k, b in enumerate(budget)])


def budgets(small: DataFrame, mixture: Mixture) -> DataFrame:
    """(source, tier, budget): whole tokens of each source in each tier; a weight of 0 gives -1."""
    totals = small.groupBy("source").agg(F.sum("tokens").alias("total")).withColumn("weight", _weight(mixture))
    tiers = F.explode(F.array(*[F.struct(F.lit(k).alias("tier"), F.col(f"level{k}").alias("level")) for k in range(len(mixture.tiers))]))
    exact = F.least(F.col("total"), F.floor(F.col("x.level") * F.col("weight") + F.lit(1e-6)).cast("bigint"))
    return (
        totals.crossJoin(F.broadcast(levels(totals, mixture)))  # one row
        .select("source", "total", "weight", tiers.alias("x"))
        .select("source", "x.tier", F.when(F.col("weight") > 0, exact).otherwise(F.lit(-1)).alias("budget"))
    )


def thresholds(small: DataFrame, mixture: Mixture) -> DataFrame:
    """(source, tier, budget, threshold): the documents with h < threshold fill the budget.

    `open_` holds for each source and tier the bucket in which its budget runs out, at the
    resolution reached so far: everything below the bucket is taken, and `left` tokens remain
    for it.  Each level aggregates only those buckets' documents, map-side first, and nothing
    is brought to the driver.
    """
    open_ = budgets(small, mixture).select("source", "tier", "budget", F.col("budget").alias("left"), F.lit(0).cast("bigint").alias("base"))
    open_ = written(open_, "mixing-budgets")
    shift, found = BITS, []
    while shift:
        bits = min(mixture.level_bits, shift)
        finer = shift - bits
        sums = small.groupBy("source", F.shiftright("h", finer).alias("bucket")).agg(F.sum("tokens").alias("tokens"))
        sums = sums.select(F.col("source").alias("source_of"), "bucket", "tokens", F.shiftright("bucket", bits).alias("parent"))
        both = open_.join(sums, F.col("source").eqNullSafe(F.col("source_of")) & (F.col("base") == F.col("parent")), "left")
        upto = F.sum("tokens").over(Window.partitionBy("source", "tier").orderBy("bucket"))
        over = F.coalesce(F.col("upto") > F.col("left"), F.lit(False))
        step = (
            both.withColumn("upto", upto)
            .groupBy("source", "tier", "budget", "left", "base")
            .agg(F.coalesce(F.sum(F.when(~over, F.col("tokens"))), F.lit(0)).alias("taken"), F.min(F.when(over, F.col("bucket"))).alias("boundary"))
        )
        step = written(step, "mixing-level")
        # Where no bucket exceeds what is left, the whole parent is taken and the search ends.
        whole = F.shiftleft(F.col("base") + 1, shift).cast("bigint")
        found.append(step.where("boundary IS NULL").select("source", "tier", "budget", whole.alias("threshold")))
        open_ = step.where("boundary IS NOT NULL").select("source", "tier", "budget", (F.col("left") - F.col("taken")).alias("left"), F.col("boundary").alias("base"))
        shift = finer
        if shift:
            edges = open_.select(F.col("source").alias("source_of"), F.col("base").alias("edge")).distinct()
            inside = F.col("source").eqNullSafe(F.col("source_of")) & (F.shiftright("h", shift) == F.col("edge"))
            small = written(small.join(edges, inside, "left_semi"), "mixing-boundary")
    found.append(open_.select("source", "tier", "budget", F.col("base").alias("threshold")))
    return reduce(DataFrame.union, found)


def tier_of(docs: DataFrame, mixture: Mixture, cuts: DataFrame, h: Column, tier: str) -> DataFrame:
    """`docs` with the column `tier` added: the smallest tier that takes a row, null for none.

    One row a source with its rising thresholds is joined on the source; the documents
    themselves are neither sorted nor, as long as that table is small enough for the session's
    broadcast threshold, shuffled.
    """
    of, hashed, *cut = fresh(docs, "mix_source", "h", *[f"cut{k}" for k in range(len(mixture.tiers))])
    by = cuts.groupBy(F.col("source").alias(of)).agg(*[F.max(F.when(F.col("tier") == k, F.col("threshold"))).alias(c) for k, c in enumerate(cut)])
    found = F.lit(None).cast("int")
    for k, c in reversed(list(enumerate(cut))):
        found = F.when(F.col(hashed) < F.col(c), F.lit(k)).otherwise(found)
    joined = docs.withColumn(hashed, h).join(by, F.col("source").cast("string").eqNullSafe(F.col(of)))
    return joined.withColumn(tier, found).drop(hashed, of, *cut)


def mix(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """(doc_id, source, tokens, tier) of the documents that the largest tier takes."""
    small = written(slim(docs, mixture), "mixing-slim")
    cuts = written(thresholds(small, mixture), "mixing-thresholds")
    kept = tier_of(small, mixture, cuts, F.col("h"), "tier").where("tier IS NOT NULL")
    return kept.select("doc_id", "source", "tokens", "tier")


def mixed(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """The rows of `docs`, with all their columns, that the largest tier takes."""
    cuts = written(thresholds(written(slim(docs, mixture), "mixing-slim"), mixture), "mixing-thresholds")
    (tier,) = fresh(docs, "tier")
    kept = tier_of(docs, mixture, cuts, id_hash(F.col("doc_id")), tier).where(F.col(tier).isNotNull())
    return kept.select(*[f"`{c}`" for c in docs.columns])


def mix_sql(mixture: Mixture) -> str:
    """The same choice, of estimated lengths, by a plain running sum over each source's sorted hashes."""
    weight = "CASE " + " ".join(f"WHEN source = '{s}' THEN {float(w)}::DOUBLE" for s, w in mixture.weights.items()) + f" ELSE {float(mixture.default_weight)}::DOUBLE END" if mixture.weights else f"{float(mixture.default_weight)}::DOUBLE"
    tiers = ", ".join(f"({k}, {float(t)}::DOUBLE)" for k, t in enumerate(mixture.tiers))
    if mixture.share is None:
        level = "SELECT tier, coalesce(min(total / weight) FILTER (WHERE total > 0), 0) * part AS level FROM used, t GROUP BY tier, part"
    else:
        level = f"""SELECT tier, max((floor(whole * ({mixture.share}::DOUBLE * part)) - before) / rest) AS level
         FROM (SELECT coalesce(sum(total) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(total) OVER () AS whole,
                      sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM used WINDOW o AS (ORDER BY total / weight, source NULLS FIRST)), t GROUP BY tier"""
    return f"""
WITH slim AS (SELECT doc_id, source, {DOC_TOKENS_SQL} AS tokens, {id_hash_sql("doc_id")} AS h FROM documents),
t(tier, part) AS (VALUES {tiers}),
totals AS (SELECT source, sum(tokens)::BIGINT AS total, {weight} AS weight FROM slim GROUP BY source),
used AS (SELECT * FROM totals WHERE weight > 0),
levels AS ({level}),
cuts AS (SELECT source, tier, CASE WHEN weight > 0 THEN least(total, floor(level * weight + 1e-6)::BIGINT) ELSE -1 END AS budget FROM totals, levels),
runs AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto FROM slim)
SELECT r.doc_id, r.source, any_value(r.tokens)::BIGINT AS tokens, min(c.tier)::INT AS tier
FROM (SELECT *, row_number() OVER () AS rid FROM runs) r JOIN cuts c ON r.source IS NOT DISTINCT FROM c.source AND r.upto <= c.budget
GROUP BY r.rid, r.doc_id, r.source"""
