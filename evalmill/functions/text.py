"""Small text and token rules of an evaluation's files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(text: Column) -> Column:
    """Letters, digits, dots, dashes and underscores; runs of others become one dash; no dots or dashes at the ends.  An error if nothing is left."""
    out = F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "-"), r"^[.-]+|[.-]+$", "")
    return F.when(out == "", F.raise_error(F.concat(F.lit("no file name in "), text)).cast("string")).otherwise(out)


def axe_tag(criterion: Column) -> Column:
    """The tag of a success criterion: wcag:1.4.3 is wcag143."""
    return F.concat(F.lit("wcag"), F.replace(F.split_part(criterion, F.lit(":"), F.lit(2)), F.lit("."), F.lit("")))


def numbers_of(criterion: Column) -> Column:
    """A dotted number as integers, which sort as versions do."""
    return F.transform(F.split(criterion, r"\."), lambda p: p.cast("int"))


def primary_criteria(keys: Column) -> Column:
    """Success criteria among requirement keys like wcag21:1.4.3, as dotted numbers in the order of versions, once each."""
    found = F.filter(F.transform(keys, lambda k: F.regexp_extract(k, r"^wcag\d*:(\d+\.\d+\.\d+)$", 1)), lambda k: k != "")
    pairs = F.array_sort(F.transform(F.array_distinct(found), lambda k: F.struct(numbers_of(k).alias("n"), k.alias("k"))))
    return F.transform(pairs, lambda p: p["k"])


def first_listed(text: Column) -> Column:
    """The dotted number that begins the first entry of a list written as text, like "['1.4.3 Contrast', ...]"."""
    found = F.regexp_extract(text, r"^\s*\[\s*['\"](\d+\.\d+\.\d+)", 1)
    return F.when(found != "", found)


def without_css_urls(css: Column) -> Column:
    """A style sheet with url(...) replaced by none, but for data: URLs."""
    return F.regexp_replace(css, r"url\((?!['\" ]*data:)[^)]*\)", "none")


def mime_of(path: Column) -> Column:
    """MIME type by suffix; octets for any other."""
    kinds = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp", "css": "text/css", "woff2": "font/woff2"}
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv)), suffix), F.lit("application/octet-stream"))


def data_uri(content: Column, mime: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))


def pseudo_truth(text: Column) -> Column:
    """A or B, by the lowest bit of the first byte of a SHA-256."""
    return F.when(F.conv(F.substring(F.sha2(text, 256), 1, 2), 16, 10).cast("int") % 2 == 0, "A").otherwise("B")


def coded_side(choice: Column, member_a: Column) -> Column:
    """A or B for a choice that names the letter or the member; null for any other."""
    return F.when((choice == "A") | (choice == member_a), "A").when(choice.isNotNull() & (choice != "cannot_tell"), "B")


def filled(template: Column, values: dict[str, Column]) -> Column:
    """A prompt with its {placeholders} filled; null values leave nothing."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return template


def capture_key(parts: list[Column]) -> Column:
    """Twenty hex digits of the SHA-256 of parts written as a JSON list."""
    return F.substring(F.sha2(F.to_json(F.array(*(p.cast("string") for p in parts))), 256), 1, 20)


def alignment(value: Column) -> Column:
    """start and end as in text that runs from the left."""
    v = F.lower(F.trim(value))
    return F.when(v == "start", "left").when(v == "end", "right").otherwise(v)


def weight_label(weight: Column) -> Column:
    n = weight.try_cast("int")
    return F.when(F.coalesce(n >= 700, weight.isin("bold", "bolder")), "bold").otherwise("normal")


def confined(inside: Column, outside: Column) -> Column:
    """Whether a change stays in its box: at most 64 pixels outside, or a twentieth of those inside."""
    return outside <= F.greatest(F.lit(64.0), F.greatest(inside, F.lit(1)) * 0.05)


def tiles_by_crop(width: Column, height: Column, each: int = 258) -> Column:
    """Image tokens by crop units: one for small images, else tiles of two thirds of the short side."""
    crop = F.floor(F.least(width, height) / 1.5)
    return F.when((width <= 384) & (height <= 384), each).otherwise(each * F.ceil(width / crop) * F.ceil(height / crop)).cast("bigint")


def patch_tokens(width: Column, height: Column, patch: int = 28, most: int | None = None) -> Column:
    """Image tokens by square patches, held to a model's most."""
    n = F.ceil(width / patch) * F.ceil(height / patch)
    return (n if most is None else F.least(n, F.lit(most))).cast("bigint")
