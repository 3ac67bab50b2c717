"""Mixing sources to target weights, with DataFrame functions alone.

A source with share p of all tokens gets a weight in proportion to p to the
power of an exponent between 0 (all alike) and 1 (as they are).  The exponent is
found by bisection, for a limit on repetitions or for a target entropy, with one
aggregate over the small table of sources for each halving.  Weights become
whole documents by block permutations: a hash deals each source's documents to
blocks of about equal size, and each repetition takes the blocks in an order of
its own, and the documents of a block in an order of its own, while the source's
budget lasts.

Texts are read twice: once to count tokens into a narrow table, on which all is
decided, and once to give the rows.  What is taken of a source's last repetition
is told by one row: the block where its budget ends and the place in that block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_prefix, written

BLOCK_TOKENS = 50_000
HALVINGS = 32


def token_count(text: str) -> Column:
    """Words between white space; the engine-side stand-in for a tokenizer's count."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def source_shares(docs: DataFrame, source_col: str, tokens_col: str) -> DataFrame:
    """(source, tokens, share) of the sources that have tokens; null is a source of its own."""
    per = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(tokens_col).alias("tokens")).where("tokens > 0")
    total = per.agg(F.sum("tokens").alias("total"))  # one row
    return per.join(F.broadcast(total)).select("source", "tokens", (F.col("tokens") / F.col("total")).alias("share"))


def _bisected(feasible, low: float, high: float) -> tuple[float, float]:
    """The ends of the last interval; ``feasible`` holds at ``high`` and not at ``low``."""
    for _ in range(HALVINGS):
        middle = (low + high) / 2
        if feasible(middle):
            high = middle
        else:
            low = middle
    return low, high


def find_exponent(shares: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget_tokens: int | None = None) -> float:
    """The exponent in 0..1, by bisection.

    For a limit on repetitions it is the smallest at which no source is taken
    more than ``max_repeats`` times: of the budget, or without one of what takes
    the commonest source once.  For an entropy (in nats) it is the largest whose
    weights reach the target.  With both, the limit wins.  Without either it is 0.
    """

    def repeats(exponent: float) -> float:
        w = F.pow("share", F.lit(exponent))
        most, z, cover = shares.agg(F.max(w / F.col("share")), F.sum(w), F.max(F.col("share") / w)).first()
        if most is None:
            return 0.0
        if budget_tokens is None:
            return most * cover
        total = shares.agg(F.sum("tokens")).first()[0]
        return most / z * min(budget_tokens / total, max_repeats)

    def entropy(exponent: float) -> float:
        w = F.pow("share", F.lit(exponent))
        z, plogp = shares.agg(F.sum(w), F.sum(w * F.log(w))).first()
        return 0.0 if z is None else math.log(z) - plogp / z

    low = 0.0
    if max_repeats is not None:
        limit = max(max_repeats, 1.0) * (1 + 1e-9)
        if repeats(0.0) > limit:
            low = _bisected(lambda e: repeats(e) <= limit, 0.0, 1.0)[1]
    if target_entropy is None or entropy(low) < target_entropy:
        return low
    if entropy(1.0) >= target_entropy:
        return 1.0
    return _bisected(lambda e: entropy(e) < target_entropy, low, 1.0)[0]


def source_budgets(shares: DataFrame, exponent: float, budget_tokens: int | None = None, max_repeats: float | None = None) -> DataFrame:
    """(source, tokens, share, weight, budget): tokens to take of each source.

    Without a total, the budget is the smallest that takes every document of
    every source at least once.  A total of more than ``max_repeats`` times all
    tokens is lowered to that, since the limit could not be kept otherwise.
    """
    powered = shares.withColumn("w", F.pow("share", F.lit(exponent)))
    z = powered.agg(F.sum("w").alias("z"), F.max(F.col("tokens") / F.col("w")).alias("cover"), F.sum("tokens").alias("all"))
    total = F.col("cover") * F.col("z")
    if budget_tokens is not None:
        total = F.lit(float(budget_tokens)) if max_repeats is None else F.least(F.lit(float(budget_tokens)), F.col("all") * max(max_repeats, 1.0))
    weighed = powered.join(F.broadcast(z)).withColumn("weight", F.col("w") / F.col("z"))
    budget = F.floor(F.col("weight") * total + 1e-6)
    budget = budget if budget_tokens is not None else F.greatest(budget, F.col("tokens"))
    return weighed.select("source", "tokens", "share", "weight", budget.cast("long").alias("budget"))


def block_value(block: Column, epoch: Column, seed: int) -> Column:
    """Where a block stands in the order of one repetition."""
    return F.xxhash64(F.lit(seed), epoch, block)


def place_value(h: Column, epoch: Column, seed: int) -> Column:
    """Where a document stands in its block in one repetition."""
    return F.xxhash64(F.lit(seed), h, epoch)


def _cuts(narrow: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """(source, cut_value, cut_block, cut_place): where the last repetition of each source ends.

    Sums go up in two steps (blocks in 4,096 ranges of their order, then one
    range), so no task sees all blocks of a source.
    """
    rows = narrow.join(plan.where("part > 0").select("source", "whole", "part", "blocks"), narrow["src"].eqNullSafe(F.col("source")))
    rows = rows.select("source", "whole", "part", "h", "tokens", F.pmod("h", "blocks").alias("block"))
    sums = rows.groupBy("source", "whole", "part", "block").agg(F.sum("tokens").alias("size"))
    sums = written(sums.withColumn("value", block_value(F.col("block"), F.col("whole"), seed)).withColumn("top", F.shiftright("value", 52)), "blocks")
    ranges = sums.groupBy("source", "part", "top").agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("top"))
    ranges = ranges.withColumn("upto", upto).where("upto - size < part and part <= upto").select(F.col("source").alias("s"), F.col("top").alias("t"), (F.col("upto") - F.col("size")).alias("base"))
    inside = sums.join(ranges, sums["source"].eqNullSafe(F.col("s")) & (sums["top"] == F.col("t")))
    upto = F.col("base") + F.sum("size").over(Window.partitionBy("source").orderBy("value", "block"))
    cut = inside.withColumn("upto", upto).where("upto - size < part and part <= upto")
    cut = written(cut.select(F.col("source").alias("s"), F.col("block").alias("cut_block"), F.col("value").alias("cut_value"), (F.col("part") - F.col("upto") + F.col("size")).alias("room")), "cut")
    last = rows.join(cut, rows["source"].eqNullSafe(F.col("s")) & (rows["block"] == F.col("cut_block")))
    last = last.groupBy("source", "cut_block", "cut_value", "room", place_value(F.col("h"), F.col("whole"), seed).alias("place")).agg(F.sum("tokens").alias("size"))
    fits = F.sum("size").over(Window.partitionBy("source").orderBy("place")) <= F.col("room")
    return last.withColumn("fits", fits).groupBy("source", "cut_block", "cut_value").agg(F.max(F.when(F.col("fits"), F.col("place"))).alias("cut_place"))


def mixed(
    docs: DataFrame,
    target_entropy: float | None = None,
    max_repeats: float | None = 2.0,
    budget_tokens: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block_tokens: int = BLOCK_TOKENS,
    seed: int = 0,
) -> DataFrame:
    """``docs`` with columns epoch, block and weight: a row for each time a document is taken.

    Whole repetitions come first; of the last, blocks in their order, and of the
    block where the budget ends the documents in theirs while their tokens fit.
    Where ``docs`` has a column epoch, block or weight, that one stays and the
    operator's is named mix_epoch and so on.  Defined cases: null is a source of
    its own; a null or empty text, or one of white space, has no tokens and is
    taken once, in epoch 0; rows that repeat an id count each, and rows that
    repeat id and text are taken together; an empty table stays empty.
    """
    p = free_prefix(docs, "_mix_")
    names = {n: n if n.lower() not in {c.lower() for c in docs.columns} else f"mix_{n}" for n in ("epoch", "block", "weight")}
    h = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    narrow = written(docs.select(F.col(source_col).alias("src"), token_count(text_col).alias("tokens"), h.alias("h")).where("tokens > 0"), "narrow")
    shares = written(source_shares(narrow, "src", "tokens"), "shares")
    exponent = find_exponent(shares, target_entropy, max_repeats, budget_tokens)
    budgets = source_budgets(shares, exponent, budget_tokens, max_repeats)
    plan = written(
        budgets.select(
            "source",
            "weight",
            F.floor(F.col("budget") / F.col("tokens")).cast("long").alias("whole"),
            (F.col("budget") % F.col("tokens")).alias("part"),
            F.ceil(F.col("tokens") / block_tokens).cast("long").alias("blocks"),
        ),
        "plan",
    )
    cuts = _cuts(narrow, plan, seed).select(F.col("source").alias("s"), "cut_block", "cut_value", "cut_place")
    told = plan.join(cuts, plan["source"].eqNullSafe(F.col("s")), "left").drop("s")
    told = written(told.select(*(F.col(c).alias(p + c) for c in told.columns)), "told")

    c = lambda name: F.col(p + name)
    rows = docs.withColumn(p + "h", h).withColumn(p + "some", F.coalesce(F.col(text_col).rlike(r"\S"), F.lit(False)))
    rows = rows.join(told, F.col(source_col).eqNullSafe(c("source")), "left")
    rows = rows.withColumn(p + "block", F.pmod(c("h"), F.coalesce(c("blocks"), F.lit(1))))
    value, place = block_value(c("block"), c("whole"), seed), place_value(c("h"), c("whole"), seed)
    before = (value < c("cut_value")) | ((value == c("cut_value")) & (c("block") < c("cut_block")))
    within = (c("block") == c("cut_block")) & (place <= c("cut_place"))
    extra = F.coalesce(before | within, F.lit(False)).cast("long")
    times = F.when(c("some"), c("whole") + extra).otherwise(F.lit(1).cast("long"))
    taken = rows.withColumn(p + "times", times).where(c("times") > 0).withColumn(p + "epoch", F.explode(F.sequence(F.lit(0).cast("long"), c("times") - 1)))
    return taken.select(*(F.col(f"`{x}`") for x in docs.columns), c("epoch").alias(names["epoch"]), c("block").alias(names["block"]), c("weight").alias(names["weight"]))
