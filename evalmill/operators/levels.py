"""One pass over items of all levels: correctness, counts, label sets, boxes, calibration.

Items have item_id, page_id, level, track, truth; results have judge, item_id,
answer, confidence, refused, ord.  Truth and answers are text; sets and boxes are
JSON in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import abstains, box_of, labels_ambiguous, labels_of, selector_of
from ..functions.canonical import rounded
from ..functions.exprs import effective_prediction, iou, normal_answer, ratio, ratio_or_null
from .scoring import calibration, expected_calibration_error, last_wins


def level_fact(items: DataFrame, results: DataFrame, judges: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Every item with every judge's last answer, read as its level reads it.

    ``judges`` is joined as Spark finds best; an unanswered item has a null ``matched``.
    """
    last = last_wins(results, ["judge", "item_id"], "ord").withColumn("matched", F.lit(True))
    grid = items.crossJoin(judges.select("judge").distinct())
    rows = grid.join(last, ["judge", "item_id"], "left")
    level, answer, truth = F.col("level"), F.coalesce("answer", F.lit("unknown")), F.col("truth")
    told = level.isin("L1", "L4")
    rows = rows.select(
        "judge", "item_id", "page_id", "level", "track", "truth", F.coalesce("matched", F.lit(False)).alias("matched"), "confidence",
        F.coalesce("refused", F.lit(False)).alias("refused"), answer.alias("answer"), F.when(told, effective_prediction(answer, truth)).alias("predicted"),
        F.when(level == "L2", labels_of(truth)).alias("gold"), F.when(level == "L2", labels_of(answer)).alias("pred"),
        F.when(level == "L3", box_of(truth)).alias("gold_box"), F.when(level == "L3", box_of(answer)).alias("pred_box"), F.when(level == "L3", selector_of(answer)).alias("selector"),
    )
    has_boxes = F.col("gold_box").isNotNull() & F.col("pred_box").isNotNull()
    rows = rows.withColumn("iou", F.when(level == "L3", F.when(has_boxes, iou("gold_box", "pred_box")).otherwise(0.0)))
    nothing = F.col("selector").isNull() & F.col("pred_box").isNull()
    correct = F.when(told, F.col("predicted") == truth).when(level == "L2", F.col("gold") == F.col("pred")).when(level == "L3", F.col("iou") >= threshold).when(level == "design_pair", F.upper(normal_answer(answer)) == F.upper(truth))
    ambiguous = F.when(told, ~normal_answer(answer).isin("yes", "no")).when(level == "L2", labels_ambiguous(answer)).when(level == "L3", nothing).otherwise(normal_answer(answer) == "")
    return rows.withColumns({"correct": F.when(F.col("matched"), correct), "ambiguous": F.col("matched") & ambiguous, "abstained": F.col("matched") & abstains(answer)})


def level_blocks(fact: DataFrame) -> DataFrame:
    """Counts and rates of each (judge, level), and of each (judge, level, track); the first have a null track."""
    c, on = F.col, F.col("matched")
    count = lambda condition: F.count_if(on & condition)
    tn, tp = count((c("truth") == "yes") & (c("predicted") == "yes")), count((c("truth") == "no") & (c("predicted") == "no"))
    fp, fn = count((c("truth") == "yes") & (c("predicted") == "no")), count((c("truth") == "no") & (c("predicted") == "yes"))
    blocks = fact.groupingSets([[c("judge"), c("level")], [c("judge"), c("level"), c("track")]], "judge", "level", "track").agg(
        count(F.lit(True)).alias("scored"), F.count_if(~on).alias("missing"), F.count_if("ambiguous").alias("ambiguous"), F.count_if("abstained").alias("abstained"),
        count(c("refused")).alias("refused"), count(c("correct")).alias("hits"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"),
        F.avg(F.when(on, c("iou"))).alias("mean_iou"), count((c("level") == "L3") & c("selector").isNotNull() & c("pred_box").isNull()).alias("selector_only"),
    )
    return blocks.withColumns({"accuracy": ratio("hits", "scored"), "f1": ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn"))})


def label_blocks(fact: DataFrame) -> DataFrame:
    """Micro and macro F1 over labels, and how pages without labels are answered, by (judge, track)."""
    rows = fact.where("level = 'L2' and matched")
    label = rows.select("judge", "track", "gold", "pred", F.explode(F.array_union("gold", "pred")).alias("label"))
    g, p = F.array_contains("gold", F.col("label")), F.array_contains("pred", F.col("label"))
    per = label.groupBy("judge", "track", "label").agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"))
    micro = ratio(2 * F.sum("tp"), 2 * F.sum("tp") + F.sum("fp") + F.sum("fn"))
    f1 = per.groupBy("judge", "track").agg(micro.alias("micro_f1"), F.avg(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("macro_f1"))
    clean = F.size("gold") == 0
    answered = clean & ~F.col("ambiguous")
    pages = rows.groupBy("judge", "track").agg(F.count_if(clean).alias("clean"), F.count_if(answered).alias("clean_answered"), F.count_if(answered & (F.size("pred") == 0)).alias("rejected"))
    rates = {"coverage": ratio_or_null("clean_answered", "clean"), "rejection": ratio_or_null("rejected", "clean"), "clean_fpr": ratio_or_null(F.col("clean_answered") - F.col("rejected"), F.col("clean_answered"))}
    out = pages.join(f1, ["judge", "track"], "left").withColumns(rates)
    return out.withColumns({"micro_f1": F.coalesce("micro_f1", F.lit(0.0)), "macro_f1": F.coalesce("macro_f1", F.lit(0.0))})


def pooled_rates(fact: DataFrame) -> DataFrame:
    """(judge, n_scored, rates, ece) over all matched rows; the calibration takes rows with a confidence and a defined correctness."""
    on = fact.where("matched")
    rate = lambda c: ratio(F.count_if(c), F.count("*"))
    rates = on.groupBy("judge").agg(F.count("*").alias("n_scored"), rate(F.col("ambiguous")).alias("ambiguous_rate"), rate(F.col("abstained")).alias("abstain_rate"), rate(F.col("refused")).alias("refusal_rate"))
    bins = calibration(on.where("correct is not null"), ["judge"], F.col("correct"))
    return rates.join(expected_calibration_error(bins, ["judge"]).select("judge", F.col("n").alias("n_calibrated"), "ece"), "judge", "left")


def blocks_by_door(fact: DataFrame, door: Column) -> DataFrame:
    """Accuracy of each (judge, door)."""
    return fact.where("matched and correct is not null").groupBy("judge", door.alias("door")).agg(F.count("*").alias("n"), F.count_if("correct").alias("correct")).withColumn("accuracy", ratio("correct", "n"))


def cells(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """(judge, track, macro_f1): the mean of each level's headline number within a track, rounded at each step.

    The headline of L1 and L4 is F1, of L2 the macro F1, of L3 the accuracy.
    """
    rows = blocks.where("track is not null and level in ('L1', 'L2', 'L3', 'L4')").join(labels.select("judge", "track", "macro_f1"), ["judge", "track"], "left")
    primary = F.when(F.col("level") == "L2", F.coalesce("macro_f1", F.lit(0.0))).when(F.col("level") == "L3", F.col("accuracy")).otherwise(F.col("f1"))
    return rows.groupBy("judge", "track").agg(rounded(F.avg(rounded(primary))).alias("track_macro_f1"))


def mean_of_tracks(cells_: DataFrame) -> DataFrame:
    return cells_.groupBy("judge").agg(F.count("*").alias("tracks"), rounded(F.avg("track_macro_f1")).alias("mean_track_macro_f1"))
