"""Queries of inference: intervals of any statistic, paired differences of judges, adjusted p-values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import register
from ..functions.exprs import confidence_bin
from ..operators import resample as R
from ..operators.scoring import mcnemar
from . import bridge as B
from .evaluation import _label_sets


@register(None)
def bootstrap_ci_macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    """The macro F1 of label sets, its labels' counts resampled together by pages."""
    rows = _label_sets(spark, sf).where("answered").select("page_id", "gold", "pred", F.explode(F.array_union("gold", "pred")).alias("label"))
    g, p = F.array_contains("gold", F.col("label")), F.array_contains("pred", F.col("label"))
    sums = rows.groupBy("page_id", "label").agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"))
    return R.bootstrap_statistic(sums, [], "page_id", "label", ["tp", "fp", "fn"], R.macro_f1())


@register(None)
def bootstrap_ci_ece(spark: SparkSession, sf: str) -> DataFrame:
    """Each judge's calibration error, its bins' sums resampled together by pages."""
    fact = B.fact(spark, sf).where("confidence is not null")
    rows = fact.select("judge", "page_id", confidence_bin(F.col("confidence")).alias("bin"), "confidence", (F.col("truth") == F.col("predicted")).cast("int").alias("ok"))
    sums = rows.groupBy("judge", "page_id", "bin").agg(F.count("*").alias("n"), F.sum("confidence").alias("confidence"), F.sum("ok").alias("ok"))
    return R.bootstrap_statistic(sums, ["judge"], "page_id", "bin", ["n", "confidence", "ok"], R.calibration_error())


def _confusion(spark: SparkSession, sf: str) -> DataFrame:
    t, p = F.col("truth"), F.col("predicted")
    counts = {"tp": (t == "no") & (p == "no"), "fn": (t == "no") & (p == "yes"), "fp": (t == "yes") & (p == "no"), "tn": (t == "yes") & (p == "yes")}
    fact = B.fact(spark, sf).where("answered").withColumn("page", F.concat_ws(":", "page_id", (F.col("item_id") % 20).cast("string")))
    return fact.groupBy("judge", "page").agg(*(F.count_if(c).alias(k) for k, c in counts.items())).withColumn("part", F.lit(0))


@register(None)
def bootstrap_ci_balanced_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return R.bootstrap_statistic(_confusion(spark, sf), ["judge"], "page", "part", ["tp", "fn", "fp", "tn"], R.balanced_accuracy())


@register(None)
def paired_judge_differences(spark: SparkSession, sf: str) -> DataFrame:
    """The difference in balanced accuracy of each pair of judges, on the pages that both answered."""
    return R.paired_bootstrap(_confusion(spark, sf), "judge", [], "page", "part", ["tp", "fn", "fp", "tn"], R.balanced_accuracy())


def _tests(spark: SparkSession, sf: str) -> DataFrame:
    """McNemar tests of all pairs of judges for each criterion; those of a page group are one family."""
    ok = B.fact(spark, sf).where("answered").select("judge", "item_id", "page_id", "criterion", (F.col("truth") == F.col("predicted")).alias("ok"))
    return R.mcnemar_p(mcnemar(ok, ["page_id", "criterion"]).where("judge_a < judge_b"))


@register(None)
def holm_adjusted(spark: SparkSession, sf: str) -> DataFrame:
    """All tests with their p-values and the adjusted ones of their family."""
    return R.holm(_tests(spark, sf), ["page_id"]).select("page_id", "criterion", "judge_a", "judge_b", "method", "p", "p_holm")


@register(
    f"""WITH {B.FACT}, ok AS (SELECT judge, item_id, page_id, criterion, truth = predicted AS ok FROM fact WHERE answered),
    m AS (SELECT a.page_id, a.criterion, a.judge AS judge_a, b.judge AS judge_b, count(*) FILTER (a.ok AND NOT b.ok) AS b, count(*) FILTER (NOT a.ok AND b.ok) AS c
      FROM ok a JOIN ok b ON a.item_id = b.item_id WHERE a.judge < b.judge GROUP BY 1, 2, 3, 4),
    e AS (SELECT *, b + c AS n, CASE WHEN b + c = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda k: CAST(factorial(CAST(b + c AS INT)) AS DOUBLE)
      / (CAST(factorial(CAST(k AS INT)) AS DOUBLE) * CAST(factorial(CAST(b + c - k AS INT)) AS DOUBLE)))) / pow(2.0::DOUBLE, b + c)) END AS p FROM m WHERE b + c < 25),
    s AS (SELECT *, round(p, 12) AS q, row_number() OVER (PARTITION BY page_id ORDER BY round(p, 12)) AS k, count(*) OVER (PARTITION BY page_id) AS tests FROM e),
    t AS (SELECT *, least(1.0::DOUBLE, q * (tests - k + 1)) AS step FROM s)
    SELECT page_id, criterion, judge_a, judge_b, round(q, 9) AS p, round(max(step) OVER (PARTITION BY page_id ORDER BY q RANGE UNBOUNDED PRECEDING), 9) AS p_holm FROM t"""
)
def holm_exact_tests(spark: SparkSession, sf: str) -> DataFrame:
    """The families of the tests that have an exact p-value, adjusted among themselves."""
    exact = _tests(spark, sf).where("method <> 'chi2'").withColumn("p", F.round("p", 12))
    return R.holm(exact, ["page_id"]).select("page_id", "criterion", "judge_a", "judge_b", F.round("p", 9).alias("p"), F.round("p_holm", 9).alias("p_holm"))
