"""Connected components of a link table, by repeated contraction.

Each round hooks every root to its smallest neighbour, shortens the hooks by
pointer jumping, maps the links to the new roots and drops the links that have
become loops.  Only row counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _jump(parents: DataFrame) -> DataFrame:
    """``parents`` (id, root) with every root replaced by its own root, until none changes."""
    while True:
        up = parents.select(F.col("id").alias("_id"), F.col("root").alias("_root"))
        parents = written(
            parents.join(up, F.col("root") == F.col("_id"), "left").select(
                "id", F.coalesce("_root", "root").alias("root"), (F.coalesce("_root", "root") != F.col("root")).alias("moved")
            ),
            "jump",
        )
        moved = parents.where("moved").limit(1).count()
        parents = parents.drop("moved")
        if not moved:
            return parents


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) for each id in ``links``; root is the smallest id reachable by links.

    Links may repeat, be loops, or stand in either order.  Null ends are no
    links.  An empty table gives an empty table.
    """
    both = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    edges = written(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    ids = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    roots = None
    while True:
        live = edges.where("a < b")
        if not live.limit(1).count():
            break
        hooks = live.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("root"))
        hooks = _jump(hooks)
        if roots is None:
            roots = written(ids.join(hooks, "id", "left").select("id", F.coalesce("root", "id").alias("root")), "roots")
        else:
            up = hooks.select(F.col("id").alias("_id"), F.col("root").alias("_root"))
            roots = written(roots.join(up, F.col("root") == F.col("_id"), "left").select("id", F.coalesce("_root", "root").alias("root")), "roots")
        ra = hooks.select(F.col("id").alias("a"), F.col("root").alias("ra"))
        rb = hooks.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        mapped = live.join(ra, "a", "left").join(rb, "b", "left").select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
        edges = written(mapped.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    return roots if roots is not None else ids.select("id", F.col("id").alias("root"))
