"""Image rules, planned calls and spending against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from evalmill.operators import estimate as E

PRICES = [("t", 2.5, 10.0, 0.5, None, 0, 512, True, "tiles", 85, 170, None, None), ("c", 0.5, 3.0, 0.5, None, 2700, 4096, True, "crop", None, None, None, None), ("p", 2.0, 10.0, 0.5, 0.055, 3, 512, True, "patch", None, None, 28, 1568), ("f", 0.2, 1.2, 1.0, None, 0, 9, True, "patch", None, None, 32, None)]
SCHEMA = "model string, price_in double, price_out double, discount double, fee double, reasoning long, budget long, batch boolean, rule string, base long, tile long, patch long, most long"


def plain_tokens(rule, w, h, base, tile, patch, most):
    if rule == "tiles":
        a, b = float(w), float(h)
        if max(a, b) > 2048:
            a, b = a * (2048 / max(a, b)), b * (2048 / max(a, b))
        if min(a, b) > 768:
            a, b = a * (768 / min(a, b)), b * (768 / min(a, b))
        return base + tile * math.ceil(a / 512) * math.ceil(b / 512)
    if rule == "crop":
        unit = math.floor(min(w, h) / 1.5)
        return 258 if w <= 384 and h <= 384 else 258 * math.ceil(w / unit) * math.ceil(h / unit)
    n = math.ceil(w / patch) * math.ceil(h / patch)
    return n if most is None else min(n, most)


def test_image_tokens_by_rule(spark):
    rng = random.Random(5)
    sizes = [(rng.randrange(2, 4000), rng.randrange(2, 4000)) for _ in range(300)] + [(384, 384), (385, 384), (960, 540), (1280, 1600), (2048, 768), (512, 512)]
    frame = spark.createDataFrame(sizes, "w long, h long").crossJoin(spark.createDataFrame(PRICES, SCHEMA))
    for r in frame.withColumn("n", E.image_tokens(F.col("w"), F.col("h"))).collect():
        assert r.n == plain_tokens(r.rule, r.w, r.h, r.base, r.tile, r.patch, r.most), r
    known = {(r.model, r.w, r.h): r.n for r in frame.withColumn("n", E.image_tokens(F.col("w"), F.col("h"))).collect()}
    assert (known["c", 960, 540], known["t", 1280, 1600], known["p", 1280, 1600]) == (6 * 258, 85 + 170 * 4, 1568)
    with pytest.raises(Exception, match="no image rule odd"):
        frame.limit(1).withColumn("rule", F.lit("odd")).select(E.image_tokens(F.col("w"), F.col("h"))).collect()


ITEMS = [(1, "a", "L1", "desktop", 401, [10]), (2, "a", "L9", "mobile", 4, [11]), (3, "b", "design_pair", "desktop", 8, [10, 12]), (4, "b", "design_pair", "desktop", 9, [13, 14]), (5, None, None, "desktop", 0, [])]
PICTURES = [(10, "desktop", 500, 900, "x"), (12, "desktop", 100, 90, "y"), (11, "desktop", 1, 1, "z")]


def tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, track string, level string, viewport string, prompt_chars long, page_ids array<long>")
    return items, spark.createDataFrame(PICTURES, "page_id long, viewport string, w long, h long, path string"), spark.createDataFrame([("desktop", 1280, 1600), ("mobile", 390, 1200)], "viewport string, w long, h long"), spark.createDataFrame(PRICES, SCHEMA)


def test_spending_matches_plain_loops(spark):
    items, pictures, fallback, prices = tables(spark)
    got = {r.model: r for r in E.spend(E.token_sums(items, pictures, fallback, prices, 2), prices).collect()}
    shots, sizes = {(p, v): (w, h) for p, v, w, h, _ in PICTURES}, {"desktop": (1280, 1600), "mobile": (390, 1200)}
    for model, p_in, p_out, discount, fee, reasoning, budget, _, rule, *numbers in PRICES:
        read = visible = exact = rest = 0
        for _, _, level, viewport, chars, pages in ITEMS:
            for page in pages:
                w, h = shots.get((page, viewport), sizes[viewport])
                exact, rest = exact + ((page, viewport) in shots), rest + ((page, viewport) not in shots)
                read += plain_tokens(rule, w, h, *numbers)
            read += math.ceil(chars / 4)
            visible += {"L1": 40, "design_pair": 40}.get(level, 50)
        r, calls = got[model], 2 * len(ITEMS)
        assert (r["items"], r.calls, r.input_tokens, r.visible_tokens, r.reasoning_tokens, r.exact_images, r.fallback_images) == (5, calls, 2 * read, 2 * visible, calls * reasoning, 2 * exact, 2 * rest)
        cost = lambda out: round(discount * (2 * read / 1e6 * p_in + out / 1e6 * p_out) * (1 + (fee or 0.0)), 2)
        assert (r.expected_usd, r.budget_usd) == (cost(2 * visible + calls * reasoning), cost(calls * budget))


def test_models_without_batches_and_unknown_viewports_fail(spark):
    items, pictures, fallback, prices = tables(spark)
    with pytest.raises(Exception, match="no batches for t"):
        E.spend(E.token_sums(items, pictures, fallback, prices), prices.withColumn("batch", F.col("model") != "t")).collect()
    with pytest.raises(Exception, match="no size for viewport mobile"):
        E.token_sums(items, pictures, fallback.where("viewport = 'desktop'"), prices).collect()


def test_planned_calls_name_what_is_missing(spark):
    items, pictures, _, _ = tables(spark)
    got = {(r.item_id, r.run): r for r in E.planned_calls(items, pictures, 20).collect()}
    assert len(got) == 80  # an item without pages sends nothing
    assert all(got[1, k].paths == ["x"] and not got[1, k].missing and got[2, k].missing == ["11:mobile"] for k in range(20))
    orders = {tuple(got[3, k].page_ids) for k in range(20)}
    assert orders == {(10, 12), (12, 10)} and all(got[3, k].paths == (["x", "y"] if got[3, k].page_ids == [10, 12] else ["y", "x"]) for k in range(20))
    assert sorted(got[4, 0].missing) == ["13:desktop", "14:desktop"] and got[4, 0].paths == []
