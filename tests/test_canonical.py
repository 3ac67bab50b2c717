"""Rounding and JSON text against CPython's own."""

import hashlib
import json
import random
import struct

from pyspark.sql import functions as F

from evalmill.functions import canonical


def odd_doubles(n=4000):
    rng = random.Random(7)
    any_ = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(n)]
    near = [rng.choice([-1, 1]) * rng.random() * 10 ** rng.randrange(-6, 12) for _ in range(n)]
    halves = [(2 * rng.randrange(10**6) + 1) / 2 / 10 ** rng.randrange(0, 7) for _ in range(n)]
    return [*any_, *near, *halves, 0.0, -0.0, 2.5, 3.5, -2.5, 0.00005, 0.5, 1e16, 1e15, 9007199254740993.0, 1e22, 5e-324, 1.7976931348623157e308, float("inf"), float("-inf"), float("nan"), 2e23, 1e23, 8.41e21, 2.0e-3, 9.999999999999999e22]


def same(a, b):
    return (a != a and b != b) or (a == b and str(a) == str(b))


def test_rounding_equals_python(spark):
    ratios = [i / j for j in range(1, 401) for i in range(j + 1)]
    frame = spark.createDataFrame([(x,) for x in ratios + odd_doubles()], "x double")
    for digits in (0, 1, 2, 4, 6, 9, 11):
        for r in frame.select("x", canonical.rounded(F.col("x"), digits).alias("y")).collect():
            if abs(r.x) * 10**digits < 2**52:
                assert same(r.y, round(r.x, digits)), (r.x, digits)
    assert spark.range(1).select(canonical.rounded(F.lit(None).cast("double")).alias("y")).first().y is None


def test_float_text_equals_python(spark):
    frame = spark.createDataFrame([(x,) for x in odd_doubles() + [i / j for j in range(1, 60) for i in range(j)]], "x double")
    for r in frame.select("x", canonical.float_text(F.col("x")).alias("t")).collect():
        assert r.t == json.dumps(r.x), r.x


TEXTS = ["", "plain", 'a "quoted" \\ text', "tab\t line\n\r\b\f\x00\x1f\x7f", "é ü ß", "漢字", "😀 x 👍🏽", " ", None, "퟿"]


def test_json_equals_python(spark):
    rng = random.Random(3)
    rows = [(t, rng.choice([None, 1.5, -0.0, 1e20, 3.0]), rng.choice([None, 7, -1]), rng.choice([None, True, False]), [rng.random() * 100, 3.0, 1e-7]) for t in TEXTS for _ in range(5)]
    frame = spark.createDataFrame(rows, "t string, x double, n long, b boolean, box array<double>")
    fields = {"text": (F.col("t"), "string"), "a": (F.col("x"), "float"), "Z": (F.col("n"), "int"), "é": (F.col("b"), "bool"), "box": (canonical.json_array(F.col("box"), "float", ", "), "json")}
    short = {**fields, "box": (canonical.json_array(F.col("box"), "float"), "json")}
    got = frame.select("t", "x", "n", "b", "box", canonical.prediction_line(fields).alias("line"), canonical.json_object(short).alias("key")).collect()
    for r in got:
        plain = {"text": r.t, "a": r.x, "Z": r.n, "é": r.b, "box": r.box}
        assert r.line == json.dumps(plain, ensure_ascii=False, sort_keys=True)
        assert r.key == json.dumps(plain, sort_keys=True, separators=(",", ":"))


def test_capture_keys_equal_python(spark):
    rows = [("p1", "desktop", None, [1.0, 2.5, 30.0, 4.0]), ("é", "mobile", "menu open", [0.1, 1e16, -3.25, 100.0])]
    frame = spark.createDataFrame(rows, "p string, v string, s string, b array<double>")
    for r in frame.select("*", canonical.capture_key(F.col("p"), F.col("v"), F.col("s"), F.col("b")).alias("k")).collect():
        said = json.dumps({"contract": "v2", "page_id": r.p, "viewport": r.v, "render_state": r.s, "bbox": r.b}, sort_keys=True, separators=(",", ":"))
        assert r.k == hashlib.sha256(said.encode()).hexdigest()[:20]
