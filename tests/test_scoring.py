"""Golden values of the scoring rules."""

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from evalmill.functions import exprs
from evalmill.operators import derive, preference, resample, scoring


def _fact(spark, rows):
    items = spark.createDataFrame([(i, "p", "L1", "c", t) for i, (t, _) in enumerate(rows)], "item_id long, page_id string, task_level string, criterion string, truth string")
    results = spark.createDataFrame([(0, i, 0, 0.5, a) for i, (_, a) in enumerate(rows) if a is not None], "judge long, item_id long, ord int, confidence double, answer string")
    return scoring.scored_fact(items, results, spark.range(1).toDF("judge"))


def test_confusion_counts_ambiguous_as_wrong(spark):
    rows = [("no", "no")] * 3 + [("no", "yes"), ("no", "maybe")] + [("yes", "yes")] * 3 + [("yes", "no"), ("yes", "unknown")]
    r = scoring.with_rates(scoring.confusion_counts(_fact(spark, rows), ["judge"])).first()
    assert (r.tp, r.fn, r.fp, r.tn, r.ambiguous, r.abstained, r.missing) == (3, 2, 2, 3, 2, 1, 0)
    assert all(math.isclose(r[c], 0.6) for c in ("precision", "recall", "f1", "specificity", "accuracy"))


def test_missing_results_are_left_out(spark):
    r = scoring.confusion_counts(_fact(spark, [("no", None), ("yes", "yes")]), ["judge"]).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.missing) == (0, 0, 0, 1, 1)


def test_undefined_rates_are_zero(spark):
    r = scoring.with_rates(scoring.confusion_counts(_fact(spark, [("yes", "yes")]), ["judge"])).first()
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)


def test_last_result_wins(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 2, "c"), (1, 1, "b")], "k long, ord int, v string")
    assert scoring.last_wins(df, ["k"], "ord").first().v == "c"


def test_multilabel(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["a"]), (1, ["b", "c"], ["b", "c"]), (1, ["a"], ["a", "c"])], "k long, gold array<string>, pred array<string>")
    r = scoring.multilabel(df, ["k"]).first()
    assert math.isclose(r.micro_f1, 0.8) and math.isclose(r.macro_f1, (1 + 2 / 3 + 2 / 3) / 3)


def test_clean_pages_without_any_are_null(spark):
    df = spark.createDataFrame([(1, ["a"], ["a"], True)], "k long, gold array<string>, pred array<string>, answered boolean")
    r = scoring.clean_pages(df, ["k"]).first()
    assert r.coverage is None and r.clean_fpr is None


def test_iou(spark):
    box = "struct<x:double,y:double,w:double,h:double>"
    rows = [((0.0, 0.0, 2.0, 2.0), b) for b in ((1.0, 1.0, 2.0, 2.0), (0.0, 0.0, 2.0, 2.0), (5.0, 5.0, 1.0, 1.0), (2.0, 0.0, 2.0, 2.0))]
    got = [r.v for r in spark.createDataFrame(rows, f"a {box}, b {box}").select(exprs.iou("a", "b").alias("v")).collect()]
    assert all(math.isclose(g, w, abs_tol=1e-12) for g, w in zip(got, (1 / 7, 1, 0, 0)))


def test_calibration_error(spark):
    fact = spark.createDataFrame([(0, 0.9, i < 9) for i in range(10)] + [(0, 0.1, i < 1) for i in range(10)] + [(1, 0.95, False)] * 20, "judge int, confidence double, ok boolean")
    bins = scoring.calibration(fact, ["judge"], F.col("ok"))
    assert bins.count() == 20
    e = {r.judge: r.ece for r in scoring.expected_calibration_error(bins, ["judge"]).collect()}
    assert math.isclose(e[0], 0, abs_tol=1e-12) and math.isclose(e[1], 0.95)


def test_mcnemar(spark):
    df = spark.createDataFrame([(1, 8, 20 / 512), (0, 0, 1.0)], "b long, c long, want double").withColumn("statistic", F.lit(None).cast("double"))
    assert all(math.isclose(r.p, r.want) for r in resample.mcnemar_p(df).collect())
    big = spark.createDataFrame([(121, 59, 3721 / 180)], "b long, c long, statistic double")
    assert resample.mcnemar_p(big).first().p < 1e-4


def test_majority_tie_takes_the_first(spark):
    df = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (1, 2, "a"), (1, 3, "b")], "k long, pos int, a string")
    r = scoring.majority_vote(df, ["k"], "a", "pos").first()
    assert (r.answer, r.runs, r.agreement) == ("b", 4, 0.5)


def test_cluster_bootstrap_of_two_pages(spark):
    df = spark.createDataFrame([("s", "a", 1, 0), ("s", "a", 1, 1), ("s", "b", 0, 2), ("s", "b", 0, 3)], "k string, page string, v int, ord int")
    r = resample.bootstrap_interval_exact_draws(resample.cluster_sums(df, ["k"], "page", "v", "ord"), ["k"], resamples=500).first()
    assert (r.lo, r.hi, r["mean"]) == (0.0, 1.0, 0.5)


def test_distributed_bootstrap_covers(spark):
    df = spark.createDataFrame([("s", f"p{i}", int(i < 70), i) for i in range(100)], "k string, page string, v int, ord int")
    sums = resample.cluster_sums(df, ["k"], "page", "v", "ord")
    r = resample.bootstrap_ratio(sums, ["k"], "page", F.col("total"), F.col("n")).first()
    assert 0.58 < r.lo < 0.66 and 0.74 < r.hi < 0.82 and r.value == 0.7 and r.clusters == 100
    again = resample.bootstrap_ratio(sums.repartition(7), ["k"], "page", F.col("total"), F.col("n")).first()
    assert (again.lo, again.hi) == (r.lo, r.hi)
    whole = resample.bootstrap_ratio(sums, [], "page", F.col("total"), F.col("n")).first()
    assert (whole.lo, whole.hi) == (r.lo, r.hi)


def test_bootstrap_ends_are_order_statistics(spark):
    keys = [r.k for r in spark.range(20).select(F.xxhash64(F.col("id").cast("string")).alias("k")).collect()]
    df = spark.createDataFrame([(str(i), float(i % 3), 2.0) for i in range(20)], "page string, num double, den double")
    w = resample._weights(np.array(keys, np.int64).view(np.uint64), np.arange(200), 5)
    stats = sorted((np.array([i % 3 for i in range(20)]) @ w) / (2.0 * w.sum(axis=0)))
    r = resample.bootstrap_ratio(df, [], "page", F.col("num"), F.col("den"), resamples=200, alpha=0.1, seed=5).first()
    assert (r.lo, r.hi) == pytest.approx((stats[10], stats[190]))
    assert 0.9 < w.mean() < 1.1


def test_strengths_by_joins_are_those_at_once(spark):
    rows = [("d1", "a", "b", 3), ("d1", "b", "a", 1), ("d1", "b", "c", 2), ("d1", "c", "a", 1), ("d2", "a", "b", 1), ("d2", "b", "a", 1)]
    edges = spark.createDataFrame(rows, "dimension string, winner string, loser string, wins long")
    once, joins = (preference.bradley_terry(edges, ["dimension"], tol=1e-3, at_once=n).orderBy("dimension", "item").collect() for n in (100, 0))
    assert [(r.dimension, r.item, r.settled) for r in once] == [(r.dimension, r.item, r.settled) for r in joins]
    assert [r.strength for r in once] == pytest.approx([r.strength for r in joins])
    one_way = preference.bradley_terry(spark.createDataFrame([("x", "y", 2)], "winner string, loser string, wins long"), max_iter=3)
    assert {r.settled for r in one_way.collect()} == {False}
    with pytest.raises(ValueError, match="no comparisons"):
        preference.bradley_terry(edges.limit(0))


def test_alpha_of_a_worked_example(spark):
    a = [None, None, None, None, None, 3, 4, 1, 2, 1, 1, 3, 3, None, 3]
    b = [1, None, 2, 1, 3, 3, 4, 3, None, None, None, None, None, None, None]
    c = [None, None, 2, 1, 3, 4, 4, None, 2, 1, 1, 3, 3, None, 4]
    rows = [(u, v) for coder in (a, b, c) for u, v in enumerate(coder)]
    df = spark.createDataFrame(rows, "unit int, value int")
    nominal = preference.krippendorff_alpha(df, [], "unit", "value").first()
    interval = preference.krippendorff_alpha(df, [], "unit", "value", interval=True).first()
    assert round(nominal.alpha, 3) == 0.691 and round(interval.alpha, 3) == 0.811 and nominal.n == 26


def test_bradley_terry_orders_items(spark):
    beta = [2, 1, 0, -1, -2]
    rows = [(i, j, round(1000 * math.exp(beta[i]) / (math.exp(beta[i]) + math.exp(beta[j])))) for i in range(5) for j in range(5) if i != j]
    got = preference.bradley_terry(spark.createDataFrame(rows, "winner int, loser int, wins long"), max_iter=12).orderBy(F.desc("strength")).collect()
    assert [r.item for r in got] == [0, 1, 2, 3, 4]


def test_image_tokens_and_contrast(spark):
    one = spark.range(1)
    assert one.select(derive.tile_tokens(F.lit(1280.0), F.lit(1600.0)).alias("t")).first().t == 765
    lum = lambda v: exprs.relative_luminance(*(F.lit(v),) * 3)
    r = one.select(exprs.contrast(lum(118), lum(255)).alias("a"), exprs.contrast(lum(0), lum(255)).alias("b"), exprs.contrast(lum(119), lum(255)).alias("c")).first()
    assert round(r.a, 2) == 4.54 and round(r.b, 6) == 21 and r.c < 4.5
