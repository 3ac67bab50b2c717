"""Cluster bootstrap intervals from sums of each cluster.

All statistics here are functions of sums over clusters, so rows are aggregated
to clusters once and only clusters are resampled.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cluster_sums(df: DataFrame, by: list[str], cluster: str, value: str, order: str) -> DataFrame:
    """(n, total, first) of each cluster; first is the smallest order, for first-seen order."""
    return df.groupBy(*by, cluster).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("double")).alias("total"), F.min(order).alias("first"))


#: Cumulative Poisson(1) masses: how often a cluster is drawn, 0 to 12 times.
_STEPS = np.cumsum([np.exp(-1.0) / math.factorial(k) for k in range(13)])[:-1]


def _weights(keys: np.ndarray, resamples: np.ndarray, seed: int) -> np.ndarray:
    """(clusters, resamples) multiplicities from hashes alone, whatever task a cluster falls to."""
    with np.errstate(over="ignore"):
        x = keys[:, None] ^ ((resamples.astype(np.uint64) + np.uint64(seed) * np.uint64(0x632BE59BD9B4E019))[None, :] * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return np.searchsorted(_STEPS, (x >> np.uint64(11)).astype(np.float64) / 2.0**53, side="right")


def bootstrap_ratio(sums: DataFrame, by: list[str], cluster: str, numerator: Column, denominator: Column, resamples: int = 10_000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(by, value, clusters, lo, hi) of a ratio of sums over clusters: a mean, an F1, a micro F1.

    Each resample draws every cluster Poisson(1) times, by a hash of (cluster,
    resample).  A task adds up its clusters for all resamples at once and gives
    ``resamples`` rows for each group, which are summed; the interval's ends are
    order statistics.  Resamples that draw nothing are left out.
    """
    named = [f for f in sums.schema if f.name in by]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named)
    rows = sums.select(*by, F.xxhash64(cluster).alias("_key"), numerator.cast("double").alias("_num"), denominator.cast("double").alias("_den"))

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        b = np.arange(resamples)
        for frame in frames:
            for group, part in frame.groupby(by, dropna=False, sort=False) if by else [((), frame)]:
                total = held.setdefault(group if isinstance(group, tuple) else (group,), np.zeros((2, resamples)))
                keys, num, den = part["_key"].to_numpy(np.int64).view(np.uint64), part["_num"].to_numpy(float), part["_den"].to_numpy(float)
                for i in range(0, len(keys), 256):
                    w = _weights(keys[i : i + 256], b, seed)
                    total += np.stack([num[i : i + 256] @ w, den[i : i + 256] @ w])
        for group, total in held.items():
            out = pd.DataFrame({"b": b, "num": total[0], "den": total[1]})
            yield out.assign(**{c: [v] * resamples for c, v in zip(by, group)})[[*by, "b", "num", "den"]]

    drawn = rows.mapInPandas(add, ", ".join(x for x in (fields, "b long, num double, den double") if x))
    stat = drawn.groupBy(*by, "b").agg(F.try_divide(F.sum("num"), F.sum("den")).alias("s")).where("s is not null")
    ends = _interval(stat, by, alpha)
    base = rows.groupBy(*by).agg(F.try_divide(F.sum("_num"), F.sum("_den")).alias("value"), F.count("*").alias("clusters"))
    return base.join(ends, by, "left") if by else base.join(F.broadcast(ends))


def _interval(stat: DataFrame, by: list[str], alpha: float) -> DataFrame:
    """(by, lo, hi): order statistics of ``s``, nulls apart; a list of a group is as long as there are resamples."""
    ends = stat.where("s is not null").groupBy(*by).agg(F.array_sort(F.collect_list("s")).alias("s"))
    n = F.size("s")
    at = lambda q: F.element_at("s", F.least((n * q).cast("int"), n - 1) + 1)
    return ends.select(*by, at(alpha / 2).alias("lo"), at(1 - alpha / 2).alias("hi"))


#: Arrays of sums that a task holds before it passes them on.
_HELD = 64


def resampled_vectors(sums: DataFrame, by: list[str], cluster: str, part: str, values: list[str], resamples: int, seed: int = 0) -> DataFrame:
    """(by, part, b, values): sums of each part of a vector in every resample; b = -1 has the sums as they are.

    ``sums`` has a row for each (by, cluster, part) that isn't zero throughout: a
    label's counts, a bin's.  A cluster is drawn equally often for all groups and
    parts.  A task holds ``_HELD`` parts x values x resamples at most.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema if f.name in (*by, part))
    rows = sums.select(*by, part, F.xxhash64(cluster).alias("_key"), *(F.col(v).cast("double").alias(v) for v in values))
    keys_of, b = [*by, part], np.arange(-1, resamples)

    def out(held: dict[tuple, np.ndarray]) -> Iterator[pd.DataFrame]:
        for group, total in held.items():
            frame = pd.DataFrame({"b": b, **dict(zip(values, total))})
            yield frame.assign(**{c: [v] * len(b) for c, v in zip(keys_of, group)})[[*keys_of, "b", *values]]

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for frame in frames:
            for group, rows_ in frame.groupby(keys_of, dropna=False, sort=False):
                if group not in held and len(held) >= _HELD:
                    yield from out(held)
                    held = {}
                total = held.setdefault(group, np.zeros((len(values), len(b))))
                keys, x = rows_["_key"].to_numpy(np.int64).view(np.uint64), rows_[values].to_numpy(float).T
                for i in range(0, len(keys), 256):
                    total[:, 1:] += x[:, i : i + 256] @ _weights(keys[i : i + 256], b[1:], seed)
                total[:, 0] += x.sum(axis=1)
        yield from out(held)

    drawn = rows.mapInPandas(add, ", ".join([fields, "b long", *(f"`{v}` double" for v in values)]))
    return drawn.groupBy(*by, part, "b").agg(*(F.sum(v).alias(v) for v in values))


def macro_f1() -> Column:
    """The mean F1 of the labels that occur, from sums tp, fp and fn of each."""
    seen = F.col("tp") + F.col("fp") + F.col("fn") > 0
    return F.avg(F.when(seen, F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))))


def calibration_error() -> Column:
    """The calibration error, from sums n, confidence and ok of each bin."""
    return F.try_divide(F.sum(F.abs(F.col("ok") - F.col("confidence"))), F.sum("n"))


def balanced_accuracy() -> Column:
    """The mean of both classes' rates of correct answers, from sums tp, fn, fp and tn; one that has no items is 0."""
    rate = lambda hit, miss: F.coalesce(F.try_divide(F.sum(hit), F.sum(hit) + F.sum(miss)), F.lit(0.0))
    drawn = F.sum(F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn")) > 0
    return F.when(drawn, (rate("tp", "fn") + rate("tn", "fp")) / 2)


def accuracy() -> Column:
    return F.try_divide(F.sum("hits"), F.sum("n"))


def bootstrap_statistic(sums: DataFrame, by: list[str], cluster: str, part: str, values: list[str], finish: Column, resamples: int = 10_000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(by, value, clusters, lo, hi) of any statistic that is an aggregate ``finish`` over the parts of a summed vector.

    Resamples in which the statistic is undefined are left out.
    """
    stat = resampled_vectors(sums, by, cluster, part, values, resamples, seed).groupBy(*by, "b").agg(finish.alias("s"))
    base = stat.where("b = -1").select(*by, F.col("s").alias("value"))
    clusters = sums.groupBy(*by).agg(F.count_distinct(cluster).alias("clusters"))
    ends = _interval(stat.where("b >= 0"), by, alpha)
    if not by:  # one row each
        return base.join(F.broadcast(clusters)).join(F.broadcast(ends))
    return base.join(clusters, by, "left").join(ends, by, "left")


def paired_bootstrap(sums: DataFrame, judge: str, by: list[str], cluster: str, part: str, values: list[str], finish: Column, resamples: int = 10_000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(by, judge_a, judge_b, clusters, value_a, value_b, difference, lo, hi) of each pair of judges, the first name the smaller.

    A pair is compared on the clusters in which both have a row, and both use the
    same draw of these in each resample, so that the interval is that of the
    difference.  A pair without shared clusters has 0 of them and nulls.
    """
    present = sums.select(*by, cluster, judge).distinct()
    a, b = (present.withColumnRenamed(judge, f"judge_{side}") for side in "ab")
    shared = a.join(b, [*by, cluster]).where("judge_a < judge_b")
    pair = [*by, "judge_a", "judge_b"]
    sides = [sums.withColumnRenamed(judge, f"judge_{side}").join(shared, [*by, cluster, f"judge_{side}"]).select(*pair, F.lit(side).alias("side"), cluster, part, *values) for side in "ab"]
    stat = resampled_vectors(sides[0].union(sides[1]), [*pair, "side"], cluster, part, values, resamples, seed).groupBy(*pair, "side", "b").agg(finish.alias("s"))
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("s")))
    both = stat.groupBy(*pair, "b").agg(of("a").alias("value_a"), of("b").alias("value_b")).withColumn("s", F.col("value_a") - F.col("value_b"))
    point = both.where("b = -1").select(*pair, "value_a", "value_b", F.col("s").alias("difference"))
    judges = present.select(*by, judge).distinct()
    left, right = (judges.withColumnRenamed(judge, f"judge_{side}") for side in "ab")
    asked = (left.join(right, by) if by else left.crossJoin(right)).where("judge_a < judge_b")  # what is asked for: every pair of judges
    counts = shared.groupBy(*pair).agg(F.count("*").alias("clusters"))
    out = asked.join(counts, pair, "left").join(point, pair, "left").join(_interval(both.where("b >= 0"), pair, alpha), pair, "left")
    return out.withColumn("clusters", F.coalesce("clusters", F.lit(0).cast("long")))


def holm(tests: DataFrame, family: list[str], p: str = "p") -> DataFrame:
    """Adds ``p_holm``: step-down adjusted p-values within each family.

    The k-th smallest of n values counts n - k + 1 times, never less than the one
    before it and at most 1; equal values get equal ones.  Null p-values stay null
    and don't count.  A family is sorted in one task: the pairs of its judges.
    """
    order = Window.partitionBy(*family, F.col(p).isNull()).orderBy(p)
    step = F.least(F.col(p) * (F.count(p).over(Window.partitionBy(*family)) - F.row_number().over(order) + 1), F.lit(1.0))
    stepped = tests.withColumn("_step", step)
    highest = F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return stepped.withColumn("p_holm", F.when(F.col(p).isNotNull(), highest)).drop("_step")


#: Resamples of a slice that one task draws.
RANGE = 500


def _draws(m: int, seed: int, skip: int) -> Iterator[np.ndarray]:
    """Indices below ``m`` as CPython's ``Random(seed).randrange(m)`` gives them, in arrays, the first ``skip`` left out.

    The generator's words come from numpy's twister, set to CPython's state; a
    word's leading bits are an index unless they reach ``m``.
    """
    state, bits = random.Random(seed).getstate()[1], m.bit_length()
    twister = np.random.MT19937()
    twister.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[:-1], np.uint32), "pos": state[-1]}}
    while True:
        words = (twister.random_raw(1 << 20) >> np.uint64(32 - bits)).astype(np.int64)
        words = words[words < m]
        kept = words[skip:]
        skip = max(0, skip - len(words))
        if len(kept):
            yield kept


def bootstrap_interval_exact_draws(sums: DataFrame, by: list[str], resamples: int = 10_000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(mean, clusters, lo, hi) with CPython's generator drawing clusters in first-seen order.

    The generator gives one sequence for a slice.  Ranges of its resamples are
    dealt to tasks, each of which passes over the draws before its own; a task
    holds two numbers for each cluster of its slice.
    """
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema if f.name in by)
    ranges = -(-resamples // RANGE)
    dealt = sums.withColumn("_range", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("first")
        n, total, m = rows["n"].to_numpy(float), rows["total"].to_numpy(float), len(rows)
        first = int(rows["_range"].iloc[0]) * RANGE
        want = min(RANGE, resamples - first)
        parts, stats = _draws(m, seed, first * m), []
        sum_n = sum_total = 0.0
        at = 0  # draws of the current resample so far
        for part in parts:
            start = 0
            while start < len(part) and len(stats) < want:
                piece = part[start : start + m - at]
                sum_n, sum_total, at, start = sum_n + n[piece].sum(), sum_total + total[piece].sum(), at + len(piece), start + len(piece)
                if at == m:
                    stats.append(sum_total / sum_n)
                    sum_n = sum_total = 0.0
                    at = 0
            if len(stats) >= want:
                break
        return pd.DataFrame({**{c: [rows[c].iloc[0]] * want for c in by}, "s": stats})

    stat = dealt.groupBy(*by, "_range").applyInPandas(run, ", ".join(x for x in (named, "s double") if x))
    base = sums.groupBy(*by).agg((F.sum("total") / F.sum("n")).alias("mean"), F.count("*").alias("clusters"))
    ends = _interval(stat, by, alpha)
    return base.join(ends, by) if by else base.join(F.broadcast(ends))


def mcnemar_p(counts: DataFrame) -> DataFrame:
    """p-values: exact below 25 discordant pairs, else chi-squared with one degree of freedom."""
    from ..functions.exprs import binomial_tail

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return x.map(lambda v: math.erfc(math.sqrt(v / 2)), na_action="ignore")

    n = F.col("b") + F.col("c")
    exact = F.least(F.lit(1.0), 2 * binomial_tail(n, F.least("b", "c")))
    return counts.withColumn("p", F.when(n == 0, 1.0).when(n < 25, exact).otherwise(tail("statistic")))
