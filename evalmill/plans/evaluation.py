"""Queries over items and answers: confusion, label sets, boxes, calibration, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import exprs
from ..operators import resample, scoring
from . import bridge as B


@register(f"WITH {B.FACT} SELECT judge, {B.COUNTS} FROM fact GROUP BY judge")
def l1_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.confusion_counts(B.fact(spark, sf), ["judge"])


@register(f"WITH {B.FACT} SELECT judge, criterion, {B.COUNTS} FROM fact GROUP BY GROUPING SETS ((judge), (judge, criterion))")
def l1_by_criterion(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.confusion_counts(B.fact(spark, sf), ["judge", "criterion"], [["judge"], ["judge", "criterion"]])


@register(
    f"""WITH {B.FACT}, c AS (SELECT judge, {B.COUNTS} FROM fact GROUP BY judge)
    SELECT judge, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS "precision", coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall,
    coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(CAST(tp + tn AS DOUBLE) / nullif(tp + fp + fn + tn, 0), 0) AS accuracy FROM c"""
)
def judge_headline(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.with_rates(scoring.confusion_counts(B.fact(spark, sf), ["judge"])).select("judge", "precision", "recall", "f1", "accuracy")


@register(f"WITH {B.FACT} SELECT judge, item_id, page_id, criterion, truth, predicted, answered, ambiguous, abstained FROM fact")
def scored_fact(spark: SparkSession, sf: str) -> DataFrame:
    return B.fact(spark, sf).select("judge", "item_id", "page_id", "criterion", "truth", "predicted", "answered", "ambiguous", "abstained")


@register(f"WITH {B.RESULTS} SELECT judge, item_id, max(ord) AS ord, arg_max(answer, ord) AS answer FROM results GROUP BY 1, 2")
def dedup_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.last_wins(B.results(spark, sf), ["judge", "item_id"], "ord").select("judge", "item_id", "ord", "answer")


@register(f"WITH {B.FACT} SELECT judge, criterion, count(*) AS items, count(*) FILTER (NOT answered) AS missing, count(*) FILTER (ambiguous) AS ambiguous FROM fact GROUP BY 1, 2")
def missing_ambiguous_rates(spark: SparkSession, sf: str) -> DataFrame:
    return B.fact(spark, sf).groupBy("judge", "criterion").agg(F.count("*").alias("items"), F.count_if(~F.col("answered")).alias("missing"), F.count_if("ambiguous").alias("ambiguous"))


@register("SELECT lang, source, count(*) AS items FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source))")
def facet_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = B.read(spark, sf, "documents").select("lang", "source")
    return d.groupingSets([[F.col("lang")], [F.col("source")], [F.col("lang"), F.col("source")]], "lang", "source").agg(F.count("*").alias("items"))


_SPLIT = "CASE WHEN CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 30 THEN 'test' ELSE 'dev' END"


@register(f"SELECT source, count(*) FILTER (s = 'dev') AS dev, count(*) FILTER (s = 'test') AS test, count(*) AS total FROM (SELECT source, {_SPLIT} AS s FROM documents) GROUP BY 1")
def source_split_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    split = F.when(exprs.hash_bucket(F.col("doc_id").cast("string"), 100) < 30, "test").otherwise("dev")
    d = B.read(spark, sf, "documents").select("source", split.alias("s"))
    return d.groupBy("source").agg(F.count_if(F.col("s") == "dev").alias("dev"), F.count_if(F.col("s") == "test").alias("test"), F.count("*").alias("total"))


@register(f"WITH {B.GOLD} SELECT item_id, page_id, truth FROM gold WHERE criterion = 'en' AND page_id <> 'src0'")
def filter_items(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.sampling import filter_items as filtered

    return filtered(B.gold(spark, sf), criterion="en", task_level="L1", page_id=None).where("page_id <> 'src0'").select("item_id", "page_id", "truth")


_SETS = """g AS (SELECT item_id, page_id, criterion, item_id % 7 AS m, n_chars % 5 AS k FROM gold),
 s AS (SELECT page_id, item_id, list_sort(list_distinct(list_filter([CASE WHEN m % 2 = 0 THEN 'a' END, CASE WHEN m % 3 = 0 THEN 'b' END, CASE WHEN m = 5 THEN 'c' END], lambda x: x IS NOT NULL))) AS gold,
   list_sort(list_distinct(list_filter([CASE WHEN (m + k) % 2 = 0 THEN 'a' END, CASE WHEN (m + k) % 3 = 0 THEN 'b' END, CASE WHEN k = 4 THEN 'd' END], lambda x: x IS NOT NULL))) AS pred, k <> 3 AS answered FROM g)"""


def _label_sets(spark: SparkSession, sf: str) -> DataFrame:
    m, k = F.col("item_id") % 7, F.col("n_chars") % 5
    array = lambda *w: F.array_compact(F.array(*(F.when(c, v) for c, v in w)))
    g = B.gold(spark, sf)
    return g.select(
        "page_id", "item_id", array((m % 2 == 0, "a"), (m % 3 == 0, "b"), (m == 5, "c")).alias("gold"),
        array(((m + k) % 2 == 0, "a"), ((m + k) % 3 == 0, "b"), (k == 4, "d")).alias("pred"), (k != 3).alias("answered"),
    )


@register(
    f"""WITH {B.GOLD}, {_SETS}, e AS (SELECT page_id, gold, pred, unnest(list_distinct(list_concat(gold, pred))) AS label FROM s),
    p AS (SELECT page_id, label, count(*) FILTER (list_contains(gold, label) AND list_contains(pred, label)) AS tp, count(*) FILTER (NOT list_contains(gold, label) AND list_contains(pred, label)) AS fp,
      count(*) FILTER (list_contains(gold, label) AND NOT list_contains(pred, label)) AS fn FROM e GROUP BY 1, 2)
    SELECT page_id, count(*) AS labels, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, CAST(2 * sum(tp) AS DOUBLE) / CAST(2 * sum(tp) + sum(fp) + sum(fn) AS DOUBLE) AS micro_f1,
      round(avg(CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn)), 9) AS macro_f1 FROM p GROUP BY 1"""
)
def l2_multilabel(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.multilabel(_label_sets(spark, sf), ["page_id"]).withColumn("macro_f1", F.round("macro_f1", 9))


@register(
    f"""WITH {B.GOLD}, {_SETS}, c AS (SELECT page_id, count(*) FILTER (len(gold) = 0) AS clean, count(*) FILTER (len(gold) = 0 AND answered) AS clean_answered,
      count(*) FILTER (len(gold) = 0 AND answered AND len(pred) = 0) AS rejected FROM s GROUP BY 1)
    SELECT page_id, clean, clean_answered, rejected, CAST(clean_answered AS DOUBLE) / nullif(clean, 0) AS coverage, CAST(rejected AS DOUBLE) / nullif(clean, 0) AS correct_rejection,
      1 - CAST(rejected AS DOUBLE) / nullif(clean, 0) AS error, CAST(clean_answered - rejected AS DOUBLE) / nullif(clean_answered, 0) AS clean_fpr FROM c"""
)
def l2_clean_pages(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.clean_pages(_label_sets(spark, sf), ["page_id"])


@register(
    f"""WITH {B.GOLD}, b AS (SELECT criterion, item_id % 50 AS x, item_id % 30 AS y, 10 + item_id % 7 AS w, 8 + item_id % 5 AS h, n_chars % 6 AS dx, n_chars % 4 AS dy FROM gold),
    v AS (SELECT criterion, CAST(greatest(0, w - dx) * greatest(0, h - dy) AS DOUBLE) / CAST(2 * w * h - greatest(0, w - dx) * greatest(0, h - dy) AS DOUBLE) AS v FROM b)
    SELECT criterion, count(*) AS scored, count(*) FILTER (v >= 0.5) AS hits, round(avg(v), 9) AS mean_iou FROM v GROUP BY 1"""
)
def l3_iou(spark: SparkSession, sf: str) -> DataFrame:
    i, n = F.col("item_id"), F.col("n_chars")
    box = lambda dx, dy: F.struct((i % 50 + dx).alias("x"), (i % 30 + dy).alias("y"), (10 + i % 7).alias("w"), (8 + i % 5).alias("h"))
    rows = B.gold(spark, sf).select("criterion", box(F.lit(0), F.lit(0)).alias("a"), box(n % 6, n % 4).alias("b"))
    return scoring.localization(rows, ["criterion"], exprs.iou("a", "b")).withColumn("mean_iou", F.round("mean_iou", 9))


@register(f"WITH {B.FACT} SELECT judge, page_id, count(*) FILTER (answered) AS answered, count(*) FILTER (truth = predicted) AS exact FROM fact GROUP BY 1, 2")
def l4_exact(spark: SparkSession, sf: str) -> DataFrame:
    return B.fact(spark, sf).groupBy("judge", "page_id").agg(F.count_if("answered").alias("answered"), F.count_if(F.col("truth") == F.col("predicted")).alias("exact"))


@register(
    f"""WITH {B.FACT}, n AS (SELECT *, replace('class' || CAST(item_id % 4 AS VARCHAR) || CASE WHEN truth = 'yes' THEN ':clean-control' ELSE '' END, ':clean-control', '') AS defect_class FROM fact)
    SELECT defect_class, {B.COUNTS} FROM n GROUP BY 1"""
)
def per_defect_class(spark: SparkSession, sf: str) -> DataFrame:
    f = B.fact(spark, sf)
    name = F.concat(F.lit("class"), (F.col("item_id") % 4).cast("string"), F.when(F.col("truth") == "yes", ":clean-control").otherwise(""))
    return scoring.per_defect(f, name).select("defect_class", "tp", "fp", "fn", "tn", "missing", "ambiguous", "abstained")


_BINS = f"""{B.FACT}, r AS (SELECT judge, least(CAST(trunc(least(greatest(confidence, 0), 1) * 10) AS INTEGER), 9) AS bin, confidence, CASE WHEN truth = predicted THEN 1 ELSE 0 END AS c FROM fact WHERE confidence IS NOT NULL),
 q AS (SELECT judge, bin, count(*) AS n, avg(confidence) AS mean_confidence, avg(c) AS accuracy FROM r GROUP BY 1, 2)"""


@register(
    f"""WITH {_BINS}, grid AS (SELECT judge, b.bin FROM (SELECT DISTINCT judge FROM q), (SELECT unnest(range(10))::INTEGER AS bin) b)
    SELECT g.judge, g.bin, coalesce(q.n, 0) AS n, round(q.mean_confidence, 9) AS mean_confidence, round(q.accuracy, 9) AS accuracy FROM grid g LEFT JOIN q ON q.judge = g.judge AND q.bin = g.bin"""
)
def ece_bins(spark: SparkSession, sf: str) -> DataFrame:
    bins = scoring.calibration(B.fact(spark, sf), ["judge"], F.col("truth") == F.col("predicted"))
    return bins.withColumn("mean_confidence", F.round("mean_confidence", 9)).withColumn("accuracy", F.round("accuracy", 9))


@register(f"WITH {_BINS} SELECT judge, sum(n)::BIGINT AS n, round(sum(n * abs(accuracy - mean_confidence)) / sum(n), 9) AS ece FROM q GROUP BY 1")
def ece_total(spark: SparkSession, sf: str) -> DataFrame:
    bins = scoring.calibration(B.fact(spark, sf), ["judge"], F.col("truth") == F.col("predicted"))
    return scoring.expected_calibration_error(bins, ["judge"]).withColumn("ece", F.round("ece", 9))


_OK = f"{B.FACT}, ok AS (SELECT judge, item_id, truth = predicted AS ok FROM fact WHERE answered)"


@register(
    f"""WITH {_OK}, p AS (SELECT a.judge AS judge_a, b.judge AS judge_b, count(*) AS shared, count(*) FILTER (a.ok AND NOT b.ok) AS b, count(*) FILTER (NOT a.ok AND b.ok) AS c
      FROM ok a JOIN ok b ON a.item_id = b.item_id WHERE a.judge <> b.judge GROUP BY 1, 2)
    SELECT judge_a, judge_b, shared, b, c, CASE WHEN b + c = 0 THEN 'none' WHEN b + c < 25 THEN 'exact' ELSE 'chi2' END AS method,
      CASE WHEN b + c >= 25 THEN CAST((abs(b - c) - 1) * (abs(b - c) - 1) AS DOUBLE) / (b + c) END AS statistic FROM p"""
)
def mcnemar_counts(spark: SparkSession, sf: str) -> DataFrame:
    f = B.fact(spark, sf).where("answered").select("judge", "item_id", (F.col("truth") == F.col("predicted")).alias("ok"))
    return scoring.mcnemar(f)


@register(
    """WITH r AS (SELECT conv_id, role, count(*) AS n, min(turn) AS first FROM conversations GROUP BY 1, 2)
    SELECT conv_id, arg_max(role, n * 1000000 - first) AS answer, sum(n)::BIGINT AS runs, CAST(max(n) AS DOUBLE) / sum(n) AS agreement FROM r GROUP BY 1"""
)
def majority_vote(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.majority_vote(B.read(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "role", "turn")


_RUN = "event_id AS pos, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE 'c' END AS answer, event_id % 41 = 0 AS refused, CAST(event_id % 10 AS DOUBLE) / 10 AS confidence"


@register(
    f"""WITH r AS (SELECT user_id, {_RUN} FROM events), g AS (SELECT user_id, answer, count(*) AS n, min(pos) AS first, arg_min(confidence, pos) AS c, bool_or(refused) AS ref FROM r GROUP BY 1, 2)
    SELECT user_id, arg_max(answer, (n, -first)) AS answer, sum(n)::BIGINT AS runs, CAST(max(n) AS DOUBLE) / sum(n) AS agreement, bool_or(ref) AS refused, arg_max(c, (n, -first)) AS confidence FROM g GROUP BY 1"""
)
def aggregated_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of an item as one answer, with whether any refused and the first such run's confidence."""
    runs = B.read(spark, sf, "events").selectExpr("user_id", *_RUN.split(", "))
    return scoring.majority_vote(runs, ["user_id"], "answer", "pos", "refused", "confidence")


@register(
    f"""WITH {B.GOLD}, m AS (SELECT criterion, truth, count(*) AS n, min(item_id) AS first FROM gold WHERE item_id % 3 <> 0 GROUP BY 1, 2),
    fit AS (SELECT criterion, arg_max(truth, n * 1000000000 - first) AS predicted FROM m GROUP BY 1)
    SELECT g.criterion, count(*) AS items, count(*) FILTER (g.truth = f.predicted) AS correct FROM gold g JOIN fit f ON f.criterion = g.criterion WHERE g.item_id % 3 = 0 GROUP BY 1"""
)
def majority_fit_predict(spark: SparkSession, sf: str) -> DataFrame:
    g = B.gold(spark, sf)
    fit = scoring.majority_vote(g.where("item_id % 3 <> 0"), ["criterion"], "truth", "item_id").select("criterion", F.col("answer").alias("predicted"))
    rows = g.where("item_id % 3 = 0").join(fit, "criterion")
    return rows.groupBy("criterion").agg(F.count("*").alias("items"), F.count_if(F.col("truth") == F.col("predicted")).alias("correct"))


@register(
    """WITH r AS (SELECT p_type, rank() OVER (PARTITION BY p_type ORDER BY p_size) + (count(*) OVER (PARTITION BY p_type, p_size) - 1) / 2.0 AS rx,
      rank() OVER (PARTITION BY p_type ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_type, p_retailprice) - 1) / 2.0 AS ry FROM part)
    SELECT p_type, count(*) AS n, round(coalesce(corr(CAST(rx AS DOUBLE), CAST(ry AS DOUBLE)), 0), 9) AS rho FROM r GROUP BY 1"""
)
def spearman_rank(spark: SparkSession, sf: str) -> DataFrame:
    p = B.read(spark, sf, "part").select("p_type", "p_size", "p_retailprice")
    return scoring.spearman(p, ["p_type"], "p_size", "p_retailprice").withColumn("rho", F.round("rho", 9))


@register(f"WITH {B.FACT} SELECT judge, page_id, count(*) AS n, sum(CASE WHEN truth = predicted THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS total, min(item_id) AS first FROM fact WHERE answered GROUP BY 1, 2")
def cluster_sufficient_stats(spark: SparkSession, sf: str) -> DataFrame:
    f = B.fact(spark, sf).where("answered").withColumn("ok", (F.col("truth") == F.col("predicted")).cast("int"))
    return resample.cluster_sums(f, ["judge"], "page_id", "ok", "item_id")


@register(None)
def bootstrap_ci_distributed(spark: SparkSession, sf: str) -> DataFrame:
    """The mean's interval from 10,000 resamples of pages."""
    return resample.bootstrap_ratio(cluster_sufficient_stats(spark, sf), ["judge"], "page_id", F.col("total"), F.col("n"))


@register(None)
def bootstrap_ci_f1(spark: SparkSession, sf: str) -> DataFrame:
    """The F1's interval: its sums over pages are resampled, not its values."""
    f = scoring.confusion_counts(B.fact(spark, sf).where("answered"), ["judge", "page_id"])
    return resample.bootstrap_ratio(f, ["judge"], "page_id", 2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))


@register(None)
def bootstrap_ci_exact_draws(spark: SparkSession, sf: str) -> DataFrame:
    return resample.bootstrap_interval_exact_draws(cluster_sufficient_stats(spark, sf), ["judge"], resamples=10_000, seed=42)


@register(None)
def mcnemar_p_values(spark: SparkSession, sf: str) -> DataFrame:
    return resample.mcnemar_p(mcnemar_counts(spark, sf))
