"""Intervals, paired differences and adjusted p-values against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalmill.operators import resample

B, ALPHA = 300, 0.1


def draws(spark, clusters, seed=0):
    """How often each cluster is drawn in each resample."""
    keys = {r.c: r.k for r in spark.createDataFrame([(c,) for c in clusters], "c string").select("c", F.xxhash64("c").alias("k")).collect()}
    return {c: resample._weights(np.array([k]).view(np.uint64), np.arange(B), seed)[0] for c, k in keys.items()}


def ends(values):
    values = sorted(v for v in values if v is not None)
    at = lambda q: values[min(int(len(values) * q), len(values) - 1)]
    return (at(ALPHA / 2), at(1 - ALPHA / 2)) if values else (None, None)


def total(rows, weight, n):
    """Sums of (cluster, part, values) by part."""
    out = {}
    for c, part, *v in rows:
        out[part] = [a + weight(c) * b for a, b in zip(out.get(part, [0.0] * n), v)]
    return out


def plain_macro(parts):
    f1 = [2 * tp / (2 * tp + fp + fn) for tp, fp, fn in parts.values() if tp + fp + fn > 0]
    return sum(f1) / len(f1) if f1 else None


def plain_ece(parts):
    n = sum(p[0] for p in parts.values())
    return sum(abs(ok - conf) for _, conf, ok in parts.values()) / n if n else None


def table(rng, names, clusters=12, parts=5):
    return [(j, f"p{c}", f"l{k}", rng.randrange(4), rng.randrange(3), rng.randrange(3)) for j in names for c in range(clusters) for k in range(parts) if rng.random() < 0.5]


@pytest.mark.parametrize("name, finish, plain", [("macro", resample.macro_f1, plain_macro), ("ece", resample.calibration_error, plain_ece)])
def test_intervals_of_vectors_equal_plain_loops(spark, monkeypatch, name, finish, plain):
    monkeypatch.setattr(resample, "_HELD", 3)
    rows = table(random.Random(3), ["x", "y"])
    names = ["tp", "fp", "fn"] if name == "macro" else ["n", "confidence", "ok"]
    frame = spark.createDataFrame(rows, f"judge string, page string, part string, {', '.join(f'{n} long' for n in names)}")
    times = draws(spark, {r[1] for r in rows})
    for partitions in (1, 5):
        got = resample.bootstrap_statistic(frame.repartition(partitions), ["judge"], "page", "part", names, finish(), B, ALPHA).collect()
        for r in got:
            own = [x[1:] for x in rows if x[0] == r.judge]
            stats = [plain(total(own, lambda c: times[c][b], 3)) for b in range(B)]
            assert (r.value, r.lo, r.hi) == pytest.approx((plain(total(own, lambda c: 1, 3)), *ends(stats)))
            assert r.clusters == len({x[0] for x in own})
    whole = resample.bootstrap_statistic(frame.where("judge = 'x'"), [], "page", "part", names, finish(), B, ALPHA).first()
    assert (whole.lo, whole.hi) == next((r.lo, r.hi) for r in got if r.judge == "x")


def test_paired_differences_equal_plain_loops(spark):
    rng = random.Random(6)
    rows = table(rng, ["a", "b", "c"]) + [("d", "elsewhere", "l0", 1, 1, 1)]
    frame = spark.createDataFrame(rows, "judge string, page string, part string, tp long, fp long, fn long")
    times = draws(spark, {r[1] for r in rows})
    for partitions in (1, 6):
        got = {(r.judge_a, r.judge_b): r for r in resample.paired_bootstrap(frame.repartition(partitions), "judge", [], "page", "part", ["tp", "fp", "fn"], resample.macro_f1(), B, ALPHA).collect()}
        assert len(got) == 6
        for (a, b), r in got.items():
            shared = {x[1] for x in rows if x[0] == a} & {x[1] for x in rows if x[0] == b}
            sides = [[x[1:] for x in rows if x[0] == j and x[1] in shared] for j in (a, b)]
            if not shared:
                assert (r.clusters, r.difference, r.lo, r.hi) == (0, None, None, None) and "d" in (a, b)
                continue
            stats = []
            for k in range(B):
                one, two = (plain_macro(total(s, lambda c: times[c][k], 3)) for s in sides)
                stats.append(None if one is None or two is None else one - two)
            one, two = (plain_macro(total(s, lambda c: 1, 3)) for s in sides)
            assert (r.clusters, r.value_a, r.value_b) == pytest.approx((len(shared), one, two))
            assert (r.difference, r.lo, r.hi) == pytest.approx((one - two, *ends(stats)))


def test_balanced_accuracy_has_no_value_without_a_draw(spark):
    frame = spark.createDataFrame([("p", 0, 2, 1, 0, 3)], "page string, part int, tp long, fn long, fp long, tn long")
    r = resample.bootstrap_statistic(frame, [], "page", "part", ["tp", "fn", "fp", "tn"], resample.balanced_accuracy(), 50).first()
    assert (r.value, r.lo, r.hi) == pytest.approx(((2 / 3 + 1) / 2,) * 3)
    empty = resample.bootstrap_statistic(frame.limit(0).withColumn("judge", F.lit("j")), ["judge"], "page", "part", ["tp", "fn", "fp", "tn"], resample.balanced_accuracy(), 50)
    assert empty.count() == 0


def test_exact_draws_equal_the_generator(spark):
    rng = random.Random(9)
    for clusters in (1, 2, 37):
        sums = [("s", f"p{i}", 1 + rng.randrange(5), float(rng.randrange(9)), i) for i in range(clusters)]
        generator, stats = random.Random(42), []
        for _ in range(1200):  # more than two ranges
            picked = [generator.randrange(clusters) for _ in range(clusters)]
            stats.append(sum(sums[i][3] for i in picked) / sum(sums[i][2] for i in picked))
        stats.sort()
        frame = spark.createDataFrame(sums, "k string, page string, n long, total double, first long")
        r = resample.bootstrap_interval_exact_draws(frame.repartition(3), ["k"], 1200, 0.05, 42).first()
        assert (r.lo, r.hi) == pytest.approx((stats[int(0.025 * 1200)], stats[int(0.975 * 1200)])) and r.clusters == clusters


def test_draws_can_be_skipped():
    generator = random.Random(5)
    want = [generator.randrange(300) for _ in range(5000)]
    got = next(resample._draws(300, 5, 4000))[:1000]
    assert got.tolist() == want[4000:]


def plain_holm(values):
    known = sorted(v for v in values if v is not None)
    steps, high = {}, 0.0
    for k, v in enumerate(known):
        high = max(high, min(1.0, v * (len(known) - k)))
        steps.setdefault(v, high)
    return [None if v is None else steps[v] for v in values]


def test_holm_worked_examples(spark):
    families = {"a": [0.01, 0.04, 0.03, 0.005], "b": [0.2, None, 0.2, 0.01], "c": [None], "d": [0.9, 0.8], "e": [0.0, 0.0, 1.0]}
    rows = [(f, i, p) for f, ps in families.items() for i, p in enumerate(ps)]
    got = {(r.f, r.i): r.p_holm for r in resample.holm(spark.createDataFrame(rows, "f string, i int, p double"), ["f"]).collect()}
    assert [got["a", i] for i in range(4)] == pytest.approx([0.03, 0.06, 0.06, 0.02])
    for f, ps in families.items():
        for i, want in enumerate(plain_holm(ps)):
            assert got[f, i] is None if want is None else math.isclose(got[f, i], want)
