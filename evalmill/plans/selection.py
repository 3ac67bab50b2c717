"""Queries that sample, split, pair and prune."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import register
from ..operators import sampling as S
from . import bridge as B

_MD5 = "md5('7:' || CAST(doc_id AS VARCHAR))"


def _documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return B.read(spark, sf, "documents").select("doc_id", *columns)


def _hash() -> Column:
    return F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string")))


@register("SELECT doc_id, CASE WHEN CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 20 THEN 'test' ELSE 'dev' END AS split FROM documents")
def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    return S.hash_split(_documents(spark, sf), F.col("doc_id").cast("string"), 20)


@register("SELECT doc_id, list_sum(list_transform(string_split(source, ''), lambda c: ascii(c)))::BIGINT % 5 AS part FROM documents")
def byte_sum_split(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf, "source").select("doc_id", (S.byte_sum(F.col("source")) % 5).alias("part"))


@register(f"SELECT doc_id, lang, rank FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_MD5}, doc_id)::INTEGER AS rank FROM documents) WHERE rank <= 5")
def quota_sample_hash(spark: SparkSession, sf: str) -> DataFrame:
    return S.first_of_each(_documents(spark, sf, "lang"), ["lang"], [_hash(), F.col("doc_id")], 5)


@register(f"SELECT doc_id, source, rank FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_MD5}, doc_id)::INTEGER AS rank FROM documents) ORDER BY rank, source LIMIT 30")
def round_robin_sample(spark: SparkSession, sf: str) -> DataFrame:
    return S.round_robin(_documents(spark, sf, "source"), ["source"], [_hash(), F.col("doc_id")], 30)


@register("SELECT item, cls, rank FROM (SELECT doc_id AS item, lang AS cls, row_number() OVER (PARTITION BY lang ORDER BY CAST(doc_id AS VARCHAR))::INTEGER AS rank FROM documents) WHERE rank <= CASE cls WHEN 'en' THEN 8 ELSE 3 END")
def class_cap_topk(spark: SparkSession, sf: str) -> DataFrame:
    d = _documents(spark, sf, "lang").select(F.col("doc_id").alias("item"), F.col("lang").alias("cls"))
    return S.first_of_each(d, ["cls"], [F.col("item").cast("string")], F.when(F.col("cls") == "en", 8).otherwise(3))


@register(
    """WITH t AS (SELECT l.doc_id, source, quality, row_number() OVER (PARTITION BY source, quality ORDER BY l.doc_id)::INTEGER AS turn FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
    SELECT doc_id, source, quality, turn, row_number() OVER (PARTITION BY source ORDER BY turn, quality)::INTEGER AS place FROM t"""
)
def outcome_interleave(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.read(spark, sf, "labels").select("doc_id", "quality").join(_documents(spark, sf, "source"), "doc_id")
    return S.interleaved(rows, ["source"], "quality", [F.col("doc_id")])


@register("SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR) LIMIT 20)")
def smallest_k_hash(spark: SparkSession, sf: str) -> DataFrame:
    return S.smallest_hashes(_documents(spark, sf), F.col("doc_id").cast("string"), 20)


@register("SELECT c.doc_id AS page, p.doc_id AS parent, c.source FROM documents c JOIN documents p ON p.doc_id = c.doc_id // 2 AND p.lang = c.lang WHERE c.doc_id > 0")
def twin_self_join(spark: SparkSession, sf: str) -> DataFrame:
    child = _documents(spark, sf, "lang", "source").where("doc_id > 0").withColumn("parent", F.expr("doc_id div 2"))
    parent = _documents(spark, sf, "lang").select(F.col("doc_id").alias("parent"), F.col("lang"))
    return child.join(parent, ["parent", "lang"]).select(F.col("doc_id").alias("page"), "parent", "source")


@register("SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_brand FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey")
def combination_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of a small group, which is what this operator returns."""
    from ..operators.relations import pairs_within

    return pairs_within(B.read(spark, sf, "part"), ["p_brand", "p_size", "p_type"], "p_partkey").select("a", "b", "p_brand")


@register("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND n_chars % 50 NOT IN (SELECT DISTINCT n_chars % 50 FROM documents WHERE doc_id % 97 = 0)")
def prune_anti(spark: SparkSession, sf: str) -> DataFrame:
    d = _documents(spark, sf, "n_chars").select("doc_id", (F.col("n_chars") % 50).alias("family"))
    families = d.where("doc_id % 97 = 0").select("family").distinct()
    return d.join(B.read(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti").join(families, "family", "left_anti").select("doc_id")


@register(
    """SELECT item, source, version FROM (
      SELECT doc_id AS item, source, 'old' AS version FROM documents WHERE source <> 'src1' UNION ALL SELECT doc_id + 1000000, source, 'new' FROM documents WHERE source = 'src1' AND doc_id % 2 = 0)"""
)
def replace_by_source(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.tables import replaced_by_source

    old = _documents(spark, sf, "source").select(F.col("doc_id").alias("item"), "source", F.lit("old").alias("version"))
    new = old.where("source = 'src1' AND item % 2 = 0").select((F.col("item") + 1000000).alias("item"), "source", F.lit("new").alias("version"))
    return replaced_by_source(old, new, "src1")


@register("SELECT coalesce(n.item, o.item) AS item, coalesce(n.v, o.v) AS v FROM (SELECT doc_id AS item, n_chars AS v FROM documents) o LEFT JOIN (SELECT doc_id AS item, CAST(-quality AS BIGINT) AS v FROM labels) n ON n.item = o.item")
def upsert_labels(spark: SparkSession, sf: str) -> DataFrame:
    o = _documents(spark, sf, "n_chars").select(F.col("doc_id").alias("item"), F.col("n_chars").alias("v"))
    n = B.read(spark, sf, "labels").select(F.col("doc_id").alias("item"), (-F.col("quality")).cast("long").alias("nv"))
    return o.join(n, "item", "left").select("item", F.coalesce("nv", "v").alias("v"))


@register("SELECT doc_id, CASE WHEN CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 4) AS BIGINT) % 100 < 20 THEN 'test' ELSE 'dev' END AS split FROM documents")
def short_hash_split(spark: SparkSession, sf: str) -> DataFrame:
    """Split by the first four hex digits of a hash."""
    from ..functions.exprs import hash_bucket

    return _documents(spark, sf).select("doc_id", F.when(hash_bucket(F.col("doc_id").cast("string"), 100, 4) < 20, "test").otherwise("dev").alias("split"))


@register(f"SELECT doc_id, lang, rank FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_MD5}, doc_id)::INTEGER AS rank FROM documents) WHERE rank <= 3")
def quota_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Three rows of each language, or an error."""
    return S.quota_sample(_documents(spark, sf, "lang"), ["lang"], [_hash(), F.col("doc_id")], 3)


_SCOPE = "CASE WHEN p_partkey % 6 = 0 THEN {l}'clarity'{r} ELSE {l}'clarity', 'polish'{r} END"


@register(
    f"""WITH t AS (SELECT 'r' || CAST(p_partkey // 60 AS VARCHAR) AS rater, p_partkey AS pair_id, p_partkey % 6 = 0 AS is_catch, unnest({_SCOPE.format(l="[", r="]")}) AS dimension FROM part),
    n AS (SELECT *, row_number() OVER (PARTITION BY rater, is_catch ORDER BY md5('0:' || rater || ':' || CAST(pair_id AS VARCHAR) || ':' || dimension), pair_id, dimension) AS turn FROM t),
    s AS (SELECT rater, count(*) FILTER (NOT is_catch) AS p, count(*) FILTER (is_catch) AS c FROM n GROUP BY 1), e AS (SELECT n.*, p, c, greatest(1, p // (c + 1)) AS every FROM n JOIN s USING (rater))
    SELECT rater, pair_id, dimension, CASE WHEN is_catch THEN least(turn * every, p) + turn ELSE turn + least(c, (turn - 1) // every) END AS place FROM e"""
)
def rater_trials(spark: SparkSession, sf: str) -> DataFrame:
    """Each rater's trials, of 60 pairs, in an order of their own, with catch trials spread among them."""
    from ..operators.relations import interleaved_catches

    pairs = B.read(spark, sf, "part").selectExpr("p_partkey AS pair_id", "CASE WHEN p_partkey % 6 = 0 THEN 'validity' ELSE 'preference' END AS pair_type", f"{_SCOPE.format(l='array(', r=')')} AS scope")
    return interleaved_catches(S.trials(pairs, F.expr("concat('r', pair_id div 60)")), ["rater"]).select("rater", "pair_id", "dimension", "place")


_VIEWS = "CASE WHEN p_partkey % 3 = 0 THEN {l}'desktop'{r} ELSE {l}'desktop', 'mobile'{r} END"


@register(
    f"""WITH p AS (SELECT p_partkey AS id, p_brand AS bucket, p_size AS grp, {_VIEWS.format(l="[", r="]")} AS v FROM part),
    m AS (SELECT a.id AS a, b.id AS b, a.bucket, a.grp, unnest(list_intersect(a.v, b.v)) AS viewport FROM p a JOIN p b ON a.bucket = b.bucket AND a.grp = b.grp AND a.id < b.id),
    g AS (SELECT *, row_number() OVER (PARTITION BY bucket, grp ORDER BY md5('0:' || CAST(a AS VARCHAR) || ':' || CAST(b AS VARCHAR) || ':' || viewport)) AS g FROM m),
    k AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY g, grp) AS k FROM g WHERE g <= 4),
    r AS (SELECT 'preference' AS pair_type, a, b, viewport FROM k WHERE k <= 4 UNION ALL SELECT 'validity', p_partkey // 2, p_partkey, 'desktop' FROM part WHERE p_partkey % 5 = 0 AND p_partkey > 1),
    f AS (SELECT *, substr(md5('0:' || CAST(a AS VARCHAR) || ':' || CAST(b AS VARCHAR) || ':' || viewport), 1, 1) < '8' AS flip FROM r)
    SELECT pair_type, CASE WHEN flip THEN b ELSE a END AS page_a, CASE WHEN flip THEN a ELSE b END AS page_b, viewport, CASE WHEN pair_type = 'validity' THEN CASE WHEN flip THEN 'A' ELSE 'B' END END AS known_worse FROM f"""
)
def build_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Validity and preference pairs of a study, at most four preference pairs a bucket."""
    part = B.read(spark, sf, "part")
    pages = part.selectExpr("p_partkey AS page_id", "p_brand AS bucket", "p_size AS `group`", f"{_VIEWS.format(l='array(', r=')')} AS viewports")
    parents = part.where("p_partkey % 5 = 0 AND p_partkey > 1").selectExpr("p_partkey AS page_id", "p_partkey div 2 AS parent")
    return S.built_pairs(pages, parents, 4)


@register(
    """WITH s AS (SELECT 'p' || CAST(p_partkey AS VARCHAR) AS page_id, unnest([0, 1, 2]) AS number, p_partkey FROM part), i AS (SELECT *, page_id || '-L4-' || CAST(number AS VARCHAR) AS item_id FROM s WHERE (p_partkey + number) % 4 <> 0),
    c AS (SELECT *, substr(md5('0:' || item_id), 1, 1) < '8' AS straight FROM i) SELECT item_id, number::INTEGER AS number, 'The text-align of #e' || CAST(number AS VARCHAR) || ' is ' || CASE WHEN straight THEN 'left' ELSE 'right' END AS text, CASE WHEN straight THEN 'yes' ELSE 'no' END AS truth FROM c"""
)
def property_assertions(spark: SparkSession, sf: str) -> DataFrame:
    """Questions on rendered properties, some told as they are and some not; numbers keep the gaps of unusable probes."""
    spec = lambda k: f"named_struct('selector', '#e{k}', 'property', 'text-align', 'value', 'left', 'other', 'right', 'box', CASE WHEN (p_partkey + {k}) % 4 <> 0 THEN array(1D, 2D, 3D, 4D) ELSE array(1D, 2D, 0D, 4D) END)"
    probes = B.read(spark, sf, "part").selectExpr("'p' || CAST(p_partkey AS STRING) AS page_id", f"array({', '.join(spec(k) for k in range(3))}) AS specs")
    return S.assertions(probes)


@register(
    """WITH i AS (SELECT doc_id AS item_id, source AS page_id, n_chars % 40 AS family, n_chars AS v FROM documents), k AS (SELECT * FROM i WHERE page_id <> 'src1' AND family NOT IN (SELECT n_chars % 40 FROM documents WHERE doc_id % 89 = 0))
    SELECT k.item_id, k.page_id, k.family, CASE WHEN l.doc_id IS NOT NULL THEN -l.quality ELSE k.v END AS v FROM k LEFT JOIN labels l ON l.doc_id = k.item_id"""
)
def reverified_items(spark: SparkSession, sf: str) -> DataFrame:
    """A label table after another measurement: pruned by page and family, and replaced item by item."""
    items = _documents(spark, sf, "source", "n_chars").selectExpr("doc_id AS item_id", "source AS page_id", "n_chars % 40 AS family", "n_chars AS v")
    new = B.read(spark, sf, "labels").select(F.col("doc_id").alias("item_id"), (-F.col("quality")).cast("long").alias("nv")).join(items, "item_id").selectExpr("item_id", "page_id", "family", "nv AS v")
    return S.reverified(items, new, items.where("page_id = 'src1'").select("page_id").distinct(), items.where("item_id % 89 = 0").select("family").distinct())


@register("SELECT doc_id AS id, 'documents' AS origin FROM documents UNION ALL SELECT event_id, 'events' FROM events UNION ALL SELECT p_partkey, 'part' FROM part")
def union_of_items(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.scoring import union_all

    return union_all([B.read(spark, sf, t).select(F.col(k).alias("id"), F.lit(t).alias("origin")) for t, k in (("documents", "doc_id"), ("events", "event_id"), ("part", "p_partkey"))])
