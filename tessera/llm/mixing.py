"""Mixing sources to target weights by temperature, in DataFrame operations alone.

Source s with T_s tokens gets the weight T_s^a / sum of T^a. The exponent a (1: in proportion, 0: equal
shares) is bisected: the largest that reaches a target entropy, then, where the smallest source would be
repeated more than allowed, the smallest that keeps to the repetition limit. One aggregation tries 31
exponents at once, which is five bisections.

A source's budget is its weight of the whole. It is realised as passes over the source: as many
whole ones as fit, and of the last one a beginning. For that pass the source's documents are dealt to
blocks and the blocks permuted, both by a hash of seed, pass and id; blocks are taken while they fit, and of
the first that doesn't, documents in order of their hash. The cut is one row per source (the block
and the last document taken), so which documents are taken, and how often, is decided row by row.

A block count of at most ``BLOCKS`` per source bounds what is ordered in one task: the blocks of a source,
and the documents of one block.

Defined results: a null source is the source ''. Rows with no tokens (null or below one) are never
taken. Equal ids of a source are taken together or not at all. A null id hashes as ''. A budget over
what the repetition limit allows in proportion leaves the exponent at 1. Extra columns pass through, but for
those named as the results, which these replace; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.plans.staging import materialise

BLOCKS, BLOCK_TOKENS, ROUNDS, GRID = 4096, 65536, 7, 32


def words(text: str) -> Column:
    """Tokens as words between ASCII white space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^ \\t\\n\\x0B\\f\\r]+")), F.lit(0)).cast("long")


def _hash(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def _tries(sources: DataFrame, exponents: list[float], budget: float) -> list:
    """Entropy and largest repetition of each exponent, in order."""
    grid = sources.select("T", F.explode(F.array(*map(F.lit, exponents))).alias("a")).withColumn("p", F.pow("T", "a"))
    sums = grid.groupBy("a").agg(F.sum("p").alias("z"), F.sum(F.col("p") * F.col("a") * F.log("T")).alias("pl"), F.max(F.pow("T", F.col("a") - 1)).alias("r"))
    return sums.select("a", (F.log("z") - F.col("pl") / F.col("z")).alias("entropy"), (F.lit(budget) * F.col("r") / F.col("z")).alias("repetition")).orderBy("a").collect()  # a row per exponent tried


def exponent(sources: DataFrame, budget: float, entropy: float | None, repetition: float | None) -> float:
    """The exponent for sources (T: tokens) that meets ``entropy`` (in nats) and, which comes first, ``repetition``."""

    def bisect(meets) -> tuple[float, float]:
        """Between which exponents ``meets`` turns: it holds at the first and not at the second."""
        low, high = (0.0, 1.0)
        for _ in range(ROUNDS):
            grid = [low + (high - low) * i / GRID for i in range(1, GRID)]
            held = sum(meets(r) for r in _tries(sources, grid, budget))
            low, high = low + (high - low) * held / GRID, low + (high - low) * (held + 1) / GRID
        return low, high

    at = 1.0
    even, plain = _tries(sources, [0.0, 1.0], budget)
    if entropy is not None and plain.entropy < entropy:
        at = bisect(lambda r: r.entropy >= entropy)[0]
    if repetition is not None and at < 1.0:
        over = _tries(sources, [at], budget)[0].repetition > repetition
        if over:
            at = 1.0 if plain.repetition > repetition else bisect(lambda r: r.repetition > repetition)[1]
    elif repetition is not None and entropy is None and plain.repetition <= repetition:
        at = 0.0 if even.repetition <= repetition else bisect(lambda r: r.repetition > repetition)[1]
    return at


def mix(docs: DataFrame, tokens: Column, budget_share: float = 1.0, entropy_share: float | None = None, repetition: float | None = 4.0, seed: int = 17, key: str = "doc_id", source: str = "source") -> DataFrame:
    """The rows of ``docs`` with _tokens, _copies (how often the mix takes the row) and _weight (its source's).

    The mix holds ``budget_share`` of all tokens. Its sources' entropy is to be ``entropy_share`` of that of
    equal shares; without it, weights are as equal as ``repetition`` (passes over a source) allows."""
    rest = [c for c in docs.columns if c not in ("_tokens", "_copies", "_weight")]
    named = docs.select(F.struct(*rest).alias("row"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), tokens.alias("_tokens"))
    thin = materialise(named.select("_source", "_key", "_tokens").where("_tokens > 0"), "tokens")
    sources = materialise(thin.groupBy("_source").agg(F.sum("_tokens").cast("double").alias("T")), "sources")
    whole = sources.agg(F.sum("T").alias("t"), F.count("*").alias("n")).first()
    if not whole.n:
        return named.select("row.*", F.coalesce("_tokens", F.lit(0)).alias("_tokens"), F.lit(0).cast("long").alias("_copies"), F.lit(None).cast("double").alias("_weight"))
    budget = whole.t * budget_share
    a = exponent(sources, budget, None if entropy_share is None else entropy_share * math.log(whole.n), repetition)
    z = sources.agg(F.sum(F.pow("T", F.lit(a)))).first()[0]
    shares = sources.withColumn("_weight", F.pow("T", F.lit(a)) / z).withColumn("_budget", F.floor(F.col("_weight") * budget))
    plan = shares.select("_source", "_weight", F.floor(F.col("_budget") / F.col("T")).alias("_passes"), F.least(F.lit(BLOCKS), F.ceil(F.col("T") / BLOCK_TOKENS)).cast("long").alias("_blocks"), (F.col("_budget") - F.floor(F.col("_budget") / F.col("T")) * F.col("T")).cast("long").alias("_rest"))
    plan = materialise(plan, "plan")
    # where each source's last pass ends
    block = F.pmod(_hash(F.lit(seed), F.lit("block"), F.col("_key")), F.col("_blocks"))
    order = _hash(F.lit(seed), F.lit("pass"), F.col("_passes"), F.col("_source"), F.col("_block"))
    inner = _hash(F.lit(seed), F.lit("inner"), F.col("_passes"), F.col("_key"))
    dealt = thin.join(plan, "_source").withColumn("_block", block)
    sums = dealt.groupBy("_source", "_block", "_passes", "_rest").agg(F.sum("_tokens").alias("t")).withColumn("_order", order)
    ends = sums.withColumn("_end", F.sum("t").over(W.partitionBy("_source").orderBy("_order", "_block").rowsBetween(W.unboundedPreceding, 0)))
    first = ends.where("_end > _rest").groupBy("_source").agg(F.min(F.struct("_order", "_block", (F.col("_rest") - F.col("_end") + F.col("t")).alias("_room"))).alias("_cut"))
    first = materialise(first, "cuts")
    last = dealt.join(first, "_source").where("_block = _cut._block").withColumn("_inner", inner)
    run = W.partitionBy("_source").orderBy("_inner", "_key").rangeBetween(W.unboundedPreceding, W.currentRow)
    within = last.withColumn("_end", F.sum("_tokens").over(run)).where("_end <= _cut._room").groupBy("_source").agg(F.max(F.struct("_inner", "_key")).alias("_last"))
    cuts = materialise(plan.join(first, "_source", "left").join(within, "_source", "left"), "cuts")
    taken = named.join(cuts, "_source", "left").withColumn("_block", block).withColumn("_order", order).withColumn("_inner", inner)
    before = (F.col("_order") < F.col("_cut._order")) | ((F.col("_order") == F.col("_cut._order")) & (F.col("_block") < F.col("_cut._block")))
    inside = (F.col("_block") == F.col("_cut._block")) & F.col("_last").isNotNull() & (F.struct("_inner", "_key") <= F.col("_last"))
    copies = F.when(F.col("_tokens") > 0, F.col("_passes") + F.coalesce((before | inside).cast("long"), F.lit(0))).otherwise(0)
    return taken.select("row.*", F.coalesce("_tokens", F.lit(0)).alias("_tokens"), copies.cast("long").alias("_copies"), "_weight")
