"""Pairwise judgments: screening, agreement, rankings and promotion.

Judgments have rater, pair_id, dimension, choice (A, B or cannot_tell), side
(left or right), is_catch, known_worse and an order column.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import ratio, ratio_or_null
from ..sources.scratch import written
from .scoring import last_wins


def prepared(judgments: DataFrame, pairs: DataFrame) -> DataFrame:
    """Last judgment of each (rater, pair, dimension), with the pair's own type and known side."""
    last = last_wins(judgments, ["rater", "pair_id", "dimension"], "ord")
    kept = last.drop("pair_type", "known_worse", "is_catch")
    return kept.join(pairs.select("pair_id", "pair_type", "known_worse"), "pair_id").withColumn("is_catch", F.col("known_worse").isNotNull())


def catch_pass_rates(judgments: DataFrame, least: float = 0.8) -> DataFrame:
    """Share of catch pairs where a rater avoids the side known to be worse; can't tell is a miss."""
    ok = F.col("choice").isin("A", "B") & (F.col("choice") != F.col("known_worse"))
    out = judgments.where("is_catch").groupBy("rater").agg(F.count("*").alias("n"), F.count_if(ok).alias("passed"))
    return out.withColumn("rate", ratio("passed", "n")).withColumn("flagged", F.col("rate") < least)


def cannot_tell_rates(judgments: DataFrame) -> DataFrame:
    """Overall (null dimension) and for each dimension."""
    return judgments.rollup("dimension").agg(F.count("*").alias("n"), F.count_if(F.col("choice") == "cannot_tell").alias("cannot_tell")).withColumn("rate", ratio("cannot_tell", "n"))


def position_bias(judgments: DataFrame) -> DataFrame:
    """Share of decided choices on the left, overall (null rater) and for each rater."""
    decided = judgments.where(F.col("side").isin("left", "right"))
    return decided.rollup("rater").agg(F.count("*").alias("n"), F.count_if(F.col("side") == "left").alias("lefts")).withColumn("left_rate", ratio_or_null("lefts", "n"))


def coincidences(ratings: DataFrame, by: list[str], unit: str, value: str) -> DataFrame:
    """Weighted pairs of values within units of two ratings or more.

    Values are counted in each unit first, so the join pairs distinct values of
    a unit, not raters.
    """
    counts = ratings.where(F.col(value).isNotNull()).groupBy(*by, unit, value).agg(F.count("*").alias("n"))
    sizes = counts.groupBy(*by, unit).agg(F.sum("n").alias("m")).where("m > 1")
    a = counts.join(sizes, [*by, unit]).withColumnRenamed(value, "c")
    b = counts.select(*by, unit, F.col(value).alias("k"), F.col("n").alias("nk"))
    both = a.join(b, [*by, unit])
    weight = F.col("n") * (F.col("nk") - F.when(F.col("c") == F.col("k"), 1).otherwise(0)) / (F.col("m") - 1)
    return both.groupBy(*by, "c", "k").agg(F.sum(weight).alias("o")).where("o > 0")


def krippendorff_alpha(ratings: DataFrame, by: list[str], unit: str, value: str, interval: bool = False) -> DataFrame:
    """1 - observed / expected disagreement; 1.0 where none is expected, no row below two pairable values."""
    o = written(coincidences(ratings, by, unit, value), "coincidences")  # small: of values, and read three times
    delta: Column = ((F.col("c") - F.col("k")) ** 2 if interval else (F.col("c") != F.col("k")).cast("int")).cast("double")
    observed = o.groupBy(*by).agg(F.sum("o").alias("n"), F.sum(F.col("o") * delta).alias("do"))
    margin = o.groupBy(*by, "c").agg(F.sum("o").alias("nc"))
    other = margin.select(*by, F.col("c").alias("k"), F.col("nc").alias("nk"))
    pairs = margin.join(other, by) if by else margin.join(other)  # of distinct values, not rows
    expected = pairs.groupBy(*by).agg(F.sum(F.col("nc") * F.col("nk") * delta).alias("de"))
    out = (observed.join(expected, by) if by else observed.join(F.broadcast(expected))).where("n >= 2")  # without groups one row each
    alpha = F.when(F.col("de") == 0, 1.0).otherwise(1 - (F.col("n") - 1) * F.col("do") / F.when(F.col("de") != 0, F.col("de")))
    return out.select(*by, "n", alpha.alias("alpha"))


def win_counts(comparisons: DataFrame, by: list[str]) -> DataFrame:
    """(winner, loser, wins) with the rows that compare an item to itself left out."""
    return comparisons.where("winner <> loser").groupBy(*by, "winner", "loser").agg(F.count("*").alias("wins"))


#: Edges, one for each ordered pair that met, up to which strengths are computed at once; joins do it beyond.
EDGES_AT_ONCE = 100_000
FLOOR = 1e-12


def _strengths(winner: list, loser: list, wins: list, max_iter: int, tol: float) -> tuple[dict, bool]:
    """Strengths of one list of edges, and whether they settled in ``max_iter`` rounds."""
    items = sorted(set(winner) | set(loser))
    place = {x: k for k, x in enumerate(items)}
    i, j = np.array([place[x] for x in winner]), np.array([place[x] for x in loser])
    n = np.asarray(wins, float)
    won = np.bincount(i, n, len(items))
    p = np.ones(len(items))
    for _ in range(max_iter):
        share = n / (p[i] + p[j])
        new = np.maximum(won / (np.bincount(i, share, len(items)) + np.bincount(j, share, len(items))), FLOOR)
        new /= np.exp(np.log(new).mean())
        moved, p = np.abs(new / p - 1).max(), new
        if moved < tol:
            break
    return dict(zip(items, p.tolist())), bool(moved < tol)


def bradley_terry(edges: DataFrame, by: list[str] | None = None, max_iter: int = 10_000, tol: float = 1e-9, at_once: int = EDGES_AT_ONCE) -> DataFrame:
    """(by, item, strength, settled): maximum-likelihood strengths with a geometric mean of 1 in each group.

    ``edges`` has winner, loser, wins.  Items that never win sink to the floor of
    1e-12.  ``settled`` is false where strengths still move after ``max_iter``
    rounds, as they do where wins run one way only.  No edges at all is an error.
    Up to ``at_once`` edges are read in one go; beyond, each
    round is one join of the edges with the strengths and one aggregate.
    """
    by, spark = by or [], edges.sparkSession
    edges = written(edges.where("winner <> loser").groupBy(*by, "winner", "loser").agg(F.sum("wins").alias("wins")), "edges")
    n = edges.count()
    if not n:
        raise ValueError("no comparisons")
    kind = {f.name: f.dataType.simpleString() for f in edges.schema}
    schema = ", ".join([*(f"`{c}` {kind[c]}" for c in by), f"item {kind['winner']}", "strength double", "settled boolean"])
    if n <= at_once:
        groups: dict[tuple, list] = {}
        for r in edges.collect():
            groups.setdefault(tuple(r[c] for c in by), []).append((r.winner, r.loser, r.wins))
        rows = []
        for g, of in groups.items():
            strengths, settled = _strengths(*map(list, zip(*of)), max_iter, tol)
            rows += [(*g, x, p, settled) for x, p in strengths.items()]
        return spark.createDataFrame(rows, schema)
    pair = edges.select(*by, F.least("winner", "loser").alias("item"), F.greatest("winner", "loser").alias("other"), "wins").groupBy(*by, "item", "other").agg(F.sum("wins").alias("n"))
    both = written(pair.union(pair.select(*by, "other", "item", "n")), "both")
    won = written(edges.groupBy(*by, F.col("winner").alias("item")).agg(F.sum("wins").alias("w")), "won")
    p = both.select(*by, "item").distinct().withColumn("p", F.lit(1.0))
    for _ in range(max_iter):
        q = p.select(*by, F.col("item").alias("other"), F.col("p").alias("q"))
        base = both.join(p, [*by, "item"]).join(q, [*by, "other"]).groupBy(*by, "item").agg(F.sum(F.col("n") / (F.col("p") + F.col("q"))).alias("d"))
        new = base.join(won, [*by, "item"], "left").select(*by, "item", F.greatest(F.coalesce("w", F.lit(0)) / F.col("d"), F.lit(FLOOR)).alias("p"))
        mean = new.groupBy(*by).agg(F.exp(F.avg(F.log("p"))).alias("g"))
        new = new.join(mean, by) if by else new.join(F.broadcast(mean))  # one row
        new = written(new.select(*by, "item", (F.col("p") / F.col("g")).alias("p")), "strengths")
        moved = new.join(p.withColumnRenamed("p", "was"), [*by, "item"]).agg(F.max(F.abs(F.col("p") / F.col("was") - 1))).first()[0]
        p = new
        if moved < tol:
            break
    return p.select(*by, "item", F.col("p").alias("strength"), F.lit(moved < tol).alias("settled"))


def trusted(judgments: DataFrame, raters: DataFrame) -> DataFrame:
    """Judgments without those of flagged raters."""
    return judgments.join(raters.where("flagged").select("rater"), "rater", "left_anti")


def promoted(judgments: DataFrame, pairs: DataFrame, alpha: DataFrame, strengths: DataFrame | None = None, n_min: int = 3, alpha_min: float = 0.667) -> DataFrame:
    """(pair_id, dimension, door, winner, n, agreement, bt_margin): the pairs that become items.

    ``judgments`` are those of trusted raters.  A preference pair needs ``n_min``
    decided judgments, a dimension whose alpha is known and high enough, and a
    majority.  Validity pairs are always taken, from how they were made.
    """
    votes = judgments.where("pair_type = 'preference' and choice in ('A', 'B')").groupBy("pair_id", "dimension").agg(
        F.count("*").alias("n"), F.count_if(F.col("choice") == "A").alias("a"), F.count_if(F.col("choice") == "B").alias("b")
    )
    human = votes.join(alpha.where(F.col("alpha") >= alpha_min).select("dimension"), "dimension", "left_semi").where((F.col("n") >= n_min) & (F.col("a") != F.col("b")))
    margin = F.lit(None).cast("double").alias("bt_margin")
    if strengths is not None:
        side = lambda s: strengths.select("dimension", F.col("item").alias(f"member_{s}"), F.col("strength").alias(f"s_{s}"))
        human = human.join(pairs.select("pair_id", "member_a", "member_b"), "pair_id").join(side("a"), ["dimension", "member_a"], "left").join(side("b"), ["dimension", "member_b"], "left")
        margin = F.abs(F.col("s_a") - F.col("s_b")).alias("bt_margin")
    winner = F.when(F.col("a") > F.col("b"), "A").otherwise("B").alias("winner")
    human = human.select("pair_id", "dimension", F.lit("human").alias("door"), winner, "n", ratio(F.greatest("a", "b"), F.col("n")).alias("agreement"), margin)
    made = pairs.where("pair_type = 'validity'").select("pair_id", "dimension", F.lit("mutation").alias("door"), F.when(F.col("known_worse") == "B", "A").otherwise("B").alias("winner"))
    empty = {"n": "long", "agreement": "double", "bt_margin": "double"}
    return human.unionByName(made.select("*", *(F.lit(None).cast(t).alias(c) for c, t in empty.items())))
