"""Scalar rules of scoring, as columns that stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Substrings that mark a refusal.
REFUSALS = ("i can't help", "i cannot help", "i can't assist", "i cannot assist", "i'm unable to", "i am unable to", "i won't", "as an ai", "i'm not able to")


def ratio(n: Column | str, d: Column | str) -> Column:
    """n / d in double precision, 0.0 where it is undefined."""
    n, d = (F.col(c) if isinstance(c, str) else c for c in (n, d))
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def ratio_or_null(n: Column | str, d: Column | str) -> Column:
    n, d = (F.col(c) if isinstance(c, str) else c for c in (n, d))
    return F.try_divide(n.cast("double"), d.cast("double"))


def normal_answer(answer: Column) -> Column:
    """In lower case, without white space of any kind around it."""
    return F.lower(F.regexp_replace(answer, r"^\s+|\s+$", ""))


def effective_prediction(answer: Column, truth: Column) -> Column:
    """yes or no as answered; anything else counts as the opposite of the truth."""
    a = normal_answer(answer)
    return F.when(a.isin("yes", "no"), a).otherwise(F.when(truth == "yes", "no").otherwise("yes"))


def label_set(answer: Column) -> Column:
    """Codes in a free answer: tokens between commas or white space that hold a colon, sorted, once each."""
    tokens = F.split(F.translate(answer, ",", " "), r"\s+")
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda t: t.contains(":"))))


def iou(a: str, b: str) -> Column:
    """Intersection over union of two boxes (structs x, y, w, h); 0 where the union is empty."""
    f = lambda s, c: F.col(f"{s}.{c}").cast("double")
    side = lambda s, c: F.greatest(F.lit(0.0), f(s, c))
    w = F.greatest(F.lit(0.0), F.least(f(a, "x") + f(a, "w"), f(b, "x") + f(b, "w")) - F.greatest(f(a, "x"), f(b, "x")))
    h = F.greatest(F.lit(0.0), F.least(f(a, "y") + f(a, "h"), f(b, "y") + f(b, "h")) - F.greatest(f(a, "y"), f(b, "y")))
    union = side(a, "w") * side(a, "h") + side(b, "w") * side(b, "h") - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def confidence_bin(confidence: Column, bins: int = 10) -> Column:
    """Equal-width bin of a confidence held to 0..1; 1 falls in the last one."""
    held = F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0))
    return F.least((held * bins).cast("int"), F.lit(bins - 1))


def hash_bucket(text: Column, buckets: int, digits: int = 8) -> Column:
    """The first hex digits of the MD5 of a text, modulo a number of buckets."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint") % buckets


def is_refusal(text: Column) -> Column:
    return F.exists(F.array(*(F.lit(p) for p in REFUSALS)), lambda p: F.lower(text).contains(p))


def scan_yes_no(text: Column, ascii_words: bool = False) -> Column:
    """The first yes or no that stands as a word; with ``ascii_words`` only A-Z, a-z, 0-9 and _ go on with a word, as in RE2."""
    pattern = r"(?i)(?<![A-Za-z0-9_])(yes|no)(?![A-Za-z0-9_])" if ascii_words else r"(?i)\b(yes|no)\b"
    found = F.lower(F.regexp_extract(text, pattern, 1))
    return F.when(found != "", found)


def text_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.coalesce(F.length(text), F.lit(0)) / 4).cast("bigint")


def css_color(text: Column) -> Column:
    """(r, g, b) of #rgb, #rrggbb, rgb() or rgba(); null for anything else."""
    t = F.lower(F.trim(text))
    short = F.regexp_replace(t, r"^#([0-9a-f])([0-9a-f])([0-9a-f])$", "#$1$1$2$2$3$3")
    six = F.regexp_extract(short, r"^#([0-9a-f]{6})$", 1)
    call = r"^rgba?\(\s*(\d{1,3})\s*,\s*(\d{1,3})\s*,\s*(\d{1,3})\s*(?:,\s*[0-9.]+\s*)?\)$"
    by_hex = F.when(six != "", F.struct(*(F.conv(F.substring(six, 2 * i + 1, 2), 16, 10).cast("double").alias(c) for i, c in enumerate("rgb"))))
    by_call = F.when(t.rlike(call), F.struct(*(F.regexp_extract(t, call, i + 1).try_cast("double").alias(c) for i, c in enumerate("rgb"))))
    return F.coalesce(by_hex, by_call)


def relative_luminance(r: Column, g: Column, b: Column) -> Column:
    """Of an sRGB colour with channels 0..255."""

    def linear(c: Column) -> Column:
        s = c / F.lit(255.0)
        return F.when(s <= 0.03928, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * linear(r) + 0.7152 * linear(g) + 0.0722 * linear(b)


def contrast(l1: Column, l2: Column) -> Column:
    return (F.greatest(l1, l2) + 0.05) / (F.least(l1, l2) + 0.05)


def binomial_tail(n: Column, k: Column) -> Column:
    """P(X <= k) for X of n fair coins, summed term by term."""
    terms = F.aggregate(
        F.sequence(F.lit(1).cast("bigint"), F.greatest(k, F.lit(1)).cast("bigint")),
        F.struct(F.lit(1.0).alias("c"), F.lit(1.0).alias("s")),
        lambda acc, i: F.struct(
            F.when(i <= k, acc["c"] * (n - i + 1) / i).otherwise(acc["c"]).alias("c"),
            F.when(i <= k, acc["s"] + acc["c"] * (n - i + 1) / i).otherwise(acc["s"]).alias("s"),
        ),
    )
    return terms["s"] / F.pow(F.lit(2.0), n)
