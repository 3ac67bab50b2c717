"""Queries over pairwise judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import register
from ..operators import preference as P
from . import bridge as B


@register(f"WITH {B.JUDGMENTS} SELECT rater, pair_id, dimension, choice, side, pair_type, known_worse FROM prepared")
def prepare_judgments(spark: SparkSession, sf: str) -> DataFrame:
    return B.prepared(spark, sf).select("rater", "pair_id", "dimension", "choice", "side", "pair_type", "known_worse")


_CATCH = f"""WITH {B.JUDGMENTS}, c AS (SELECT rater, count(*) AS n, count(*) FILTER (choice IN ('A', 'B') AND choice <> known_worse) AS passed FROM prepared WHERE is_catch GROUP BY 1)"""


@register(f"{_CATCH} SELECT rater, n, passed, CAST(passed AS DOUBLE) / n AS rate, CAST(passed AS DOUBLE) / n < 0.8 AS flagged FROM c")
def catch_pass_rate(spark: SparkSession, sf: str) -> DataFrame:
    return P.catch_pass_rates(B.prepared(spark, sf))


@register(f"WITH {B.JUDGMENTS} SELECT dimension, count(*) AS n, count(*) FILTER (choice = 'cannot_tell') AS cannot_tell, CAST(count(*) FILTER (choice = 'cannot_tell') AS DOUBLE) / count(*) AS rate FROM prepared GROUP BY ROLLUP (dimension)")
def cannot_tell_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return P.cannot_tell_rates(B.prepared(spark, sf))


@register(f"WITH {B.JUDGMENTS} SELECT rater, count(*) AS n, count(*) FILTER (side = 'left') AS lefts, CAST(count(*) FILTER (side = 'left') AS DOUBLE) / count(*) AS left_rate FROM prepared WHERE side IN ('left', 'right') GROUP BY ROLLUP (rater)")
def position_bias(spark: SparkSession, sf: str) -> DataFrame:
    return P.position_bias(B.prepared(spark, sf))


_O = f"""{B.JUDGMENTS}, n AS (SELECT dimension, pair_id, choice, count(*) AS n FROM prepared WHERE pair_type = 'preference' AND choice <> 'cannot_tell' GROUP BY 1, 2, 3),
 m AS (SELECT dimension, pair_id, sum(n) AS m FROM n GROUP BY 1, 2 HAVING sum(n) > 1),
 o AS (SELECT a.dimension, a.choice AS c, b.choice AS k, sum(CAST(a.n * (b.n - CASE WHEN a.choice = b.choice THEN 1 ELSE 0 END) AS DOUBLE) / CAST(m.m - 1 AS DOUBLE)) AS o
   FROM n a JOIN n b ON a.dimension = b.dimension AND a.pair_id = b.pair_id JOIN m ON m.dimension = a.dimension AND m.pair_id = a.pair_id GROUP BY 1, 2, 3 HAVING sum(a.n * (b.n - CASE WHEN a.choice = b.choice THEN 1 ELSE 0 END)) > 0)"""


def _ratings(spark: SparkSession, sf: str) -> DataFrame:
    return B.prepared(spark, sf).where("pair_type = 'preference' AND choice <> 'cannot_tell'").select("dimension", "pair_id", "choice")


@register(f"WITH {_O} SELECT dimension, c, k, round(o, 6) AS o FROM o")
def alpha_coincidence(spark: SparkSession, sf: str) -> DataFrame:
    return P.coincidences(_ratings(spark, sf), ["dimension"], "pair_id", "choice").withColumn("o", F.round("o", 6))


_ALPHA = f"""{_O}, t AS (SELECT dimension, sum(o) AS n, sum(CASE WHEN c <> k THEN o ELSE 0 END) AS d FROM o GROUP BY 1),
 mg AS (SELECT dimension, c, sum(o) AS nc FROM o GROUP BY 1, 2),
 e AS (SELECT a.dimension, sum(CASE WHEN a.c <> b.c THEN a.nc * b.nc ELSE 0 END) AS e FROM mg a JOIN mg b ON a.dimension = b.dimension GROUP BY 1),
 alpha AS (SELECT t.dimension, t.n, CASE WHEN e.e = 0 THEN 1.0 ELSE 1 - (t.n - 1) * t.d / e.e END AS alpha FROM t JOIN e ON e.dimension = t.dimension WHERE t.n >= 2)"""


@register(f"WITH {_ALPHA} SELECT dimension, round(n, 6) AS n, round(CAST(alpha AS DOUBLE), 9) AS alpha FROM alpha")
def alpha_nominal(spark: SparkSession, sf: str) -> DataFrame:
    a = P.krippendorff_alpha(_ratings(spark, sf), ["dimension"], "pair_id", "choice")
    return a.select("dimension", F.round("n", 6).alias("n"), F.round("alpha", 9).alias("alpha"))


_TRUSTED = f"""{B.JUDGMENTS}, flagged AS (SELECT rater FROM prepared WHERE is_catch GROUP BY 1 HAVING CAST(count(*) FILTER (choice IN ('A', 'B') AND choice <> known_worse) AS DOUBLE) / count(*) < 0.8),
 everyone AS (SELECT * FROM prepared), trusted AS (SELECT * FROM everyone WHERE rater NOT IN (SELECT rater FROM flagged))"""
_KEPT = _TRUSTED + _ALPHA.removeprefix(B.JUDGMENTS).replace("FROM prepared", "FROM trusted")


def _trusted(spark: SparkSession, sf: str) -> DataFrame:
    j = B.prepared(spark, sf)
    return P.trusted(j, P.catch_pass_rates(j))


def _alpha(kept: DataFrame) -> DataFrame:
    ratings = kept.where("pair_type = 'preference' AND choice <> 'cannot_tell'").select("dimension", "pair_id", "choice")
    return P.krippendorff_alpha(ratings, ["dimension"], "pair_id", "choice")


@register(
    f"""WITH {_KEPT}, v AS (SELECT pair_id, dimension, count(*) AS n, count(*) FILTER (choice = 'A') AS a, count(*) FILTER (choice = 'B') AS b FROM trusted WHERE pair_type = 'preference' AND choice IN ('A', 'B') GROUP BY 1, 2)
    SELECT v.pair_id, v.dimension, 'human' AS door, CASE WHEN a > b THEN 'A' ELSE 'B' END AS winner, n, CAST(greatest(a, b) AS DOUBLE) / n AS agreement FROM v JOIN (SELECT dimension, alpha FROM alpha WHERE alpha >= 0.667) k ON k.dimension = v.dimension WHERE n >= 3 AND a <> b
    UNION ALL SELECT pair_id, 'clarity', 'mutation', CASE WHEN known_worse = 'B' THEN 'A' ELSE 'B' END, NULL, NULL FROM typed WHERE pair_type = 'validity'""".replace("k.dimension = v.dimension WHERE n", "k.dimension = v.dimension WHERE v.n").replace("'B' END AS winner, n, CAST(greatest(a, b) AS DOUBLE) / n AS", "'B' END AS winner, v.n, CAST(greatest(a, b) AS DOUBLE) / v.n AS")
)
def promote_gates(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs that become items, by the default gates: catch rate 0.8, alpha 0.667, three judgments, a majority."""
    kept = _trusted(spark, sf)
    pairs = B.pairs(spark).withColumn("dimension", F.lit("clarity"))
    return P.promoted(kept, pairs, _alpha(kept)).drop("bt_margin")


def _member(side: str) -> F.Column:
    return (F.col("pair_id") * (3 if side == "a" else 7) + (0 if side == "a" else 1)) % 12


def _edges(kept: DataFrame) -> DataFrame:
    """Members of each decided pair as winner and loser, by dimension."""
    rows = kept.where("pair_type = 'preference' and choice in ('A', 'B')")
    a = F.col("choice") == "A"
    return P.win_counts(rows.select("dimension", F.when(a, _member("a")).otherwise(_member("b")).alias("winner"), F.when(a, _member("b")).otherwise(_member("a")).alias("loser")), ["dimension"])


@register(
    f"""WITH {_TRUSTED}, e AS (SELECT dimension, (pair_id * 3) % 12 AS ma, (pair_id * 7 + 1) % 12 AS mb, choice FROM trusted WHERE pair_type = 'preference' AND choice IN ('A', 'B'))
    SELECT dimension, CASE WHEN choice = 'A' THEN ma ELSE mb END AS winner, CASE WHEN choice = 'A' THEN mb ELSE ma END AS loser, count(*) AS wins FROM e WHERE ma <> mb GROUP BY ALL"""
)
def bt_edges_by_dimension(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(_trusted(spark, sf))


@register(None)
def bt_by_dimension(spark: SparkSession, sf: str) -> DataFrame:
    return P.bradley_terry(_edges(_trusted(spark, sf)), ["dimension"])


@register(None)
def promoted_with_margins(spark: SparkSession, sf: str) -> DataFrame:
    """The promoted pairs with the distance of their members' strengths."""
    kept = _trusted(spark, sf)
    pairs = B.pairs(spark).withColumns({"dimension": F.lit("clarity"), "member_a": _member("a"), "member_b": _member("b")})
    return P.promoted(kept, pairs, _alpha(kept), P.bradley_terry(_edges(kept), ["dimension"]))


@register(
    f"""WITH {_ALPHA}, d AS (SELECT dimension, count(*) AS judgments, count(DISTINCT rater) AS raters, CAST(count(*) FILTER (choice = 'cannot_tell') AS DOUBLE) / count(*) AS cannot_tell FROM prepared GROUP BY 1),
    r AS (SELECT unnest(['clarity', 'balance', 'polish', 'rhythm']) AS dimension) SELECT r.dimension, d.judgments, d.raters, d.cannot_tell, round(CAST(a.alpha AS DOUBLE), 9) AS alpha FROM r LEFT JOIN d ON d.dimension = r.dimension LEFT JOIN alpha a ON a.dimension = r.dimension"""
)
def analyze_report(spark: SparkSession, sf: str) -> DataFrame:
    """Every dimension of the rubric with its counts and agreement, null where nobody judged it."""
    j = B.prepared(spark, sf)
    rubric = spark.createDataFrame([(d,) for d in ("clarity", "balance", "polish", "rhythm")], "dimension string")
    told = j.groupBy("dimension").agg(F.count("*").alias("judgments"), F.count_distinct("rater").alias("raters"), (F.count_if(F.col("choice") == "cannot_tell").cast("double") / F.count("*")).alias("cannot_tell"))
    return rubric.join(told, "dimension", "left").join(_alpha(j).select("dimension", F.round("alpha", 9).alias("alpha")), "dimension", "left")


_BT = """WITH s AS (SELECT l_orderkey, l_suppkey % 20 AS item, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
 SELECT a.item AS winner, b.item AS loser, count(*) AS wins FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.q > b.q GROUP BY 1, 2"""


@register(_BT)
def bt_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers of an order compared by quantity; an order has a few lines, so its pairs are few."""
    s = B.read(spark, sf, "lineitem").groupBy("l_orderkey", (F.col("l_suppkey") % 20).alias("item")).agg(F.sum("l_quantity").alias("q"))
    a, b = s.select("l_orderkey", F.col("item").alias("winner"), F.col("q").alias("qa")), s.select("l_orderkey", F.col("item").alias("loser"), F.col("q").alias("qb"))
    return P.win_counts(a.join(b, "l_orderkey").where("qa > qb").select("winner", "loser"), [])


@register(None)
def bradley_terry(spark: SparkSession, sf: str) -> DataFrame:
    return P.bradley_terry(bt_edges(spark, sf))
