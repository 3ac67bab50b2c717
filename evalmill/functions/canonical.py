"""Numbers and JSON written so that their text is always the same: exact decimal rounding, shortest floats, sorted keys.

All of it is column expressions; nothing leaves generated code but the parts
that are stated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLITTER = 134217729.0  # 2**27 + 1
_BIG = float(1 << 52)


def rounded(x: Column, digits: int = 4) -> Column:
    """The double nearest to ``x`` rounded to ``digits`` (0 to 11) decimals, by the exact value of ``x``, halves to even.

    The product of ``x`` and a power of ten is taken as an unevaluated sum of two
    doubles, which is exact: the half of ``x`` with the upper bits times the power
    has no more than 53 bits.  The upper double tells the rounding unless it lies
    on a half; there, the sign of the lower one does.  Numbers too large for
    decimals, infinite ones and NaN stay as they are.
    """
    if not 0 <= digits <= 11:
        raise ValueError("digits must be from 0 to 11")
    x, scale = x.cast("double"), F.lit(float(10**digits))
    a = F.abs(x)
    spread = a * F.lit(_SPLITTER)
    upper = spread - (spread - a)
    product = a * scale
    rest = (upper * scale - product) + (a - upper) * scale
    whole = F.floor(product).cast("double")
    part = product - whole
    odd = whole % 2 == 1
    up = (part > 0.5) | ((part == 0.5) & ((rest > 0) | ((rest == 0) & odd)))
    value = (whole + F.when(up, 1.0).otherwise(0.0)) / scale
    return F.when(product < _BIG, F.when((x < 0) | (x.cast("string") == "-0.0"), -value).otherwise(value)).otherwise(x)


def float_text(x: Column) -> Column:
    """The shortest decimal text that reads back as ``x``, with a point or an exponent always, as Python writes it."""
    x = x.cast("double")
    a = F.abs(x)
    tries = (F.format_string(f"%.{k}e", a) for k in range(17))
    found = F.coalesce(*(F.when(t.try_cast("double") == a, t) for t in tries))
    text = F.transform(F.array(found), _spelled)[0]  # the search stands in the expression once
    text = F.when(a == 0, "0.0").otherwise(text)
    text = F.concat(F.when((x < 0) | (x.cast("string") == "-0.0"), "-").otherwise(""), text)
    return F.when(F.isnan(x), "NaN").when(a == float("inf"), F.when(x > 0, "Infinity").otherwise("-Infinity")).when(x.isNotNull(), text)


def _spelled(found: Column) -> Column:
    """A number written with an exponent, as Python writes it: with a point only from 1e-4 up to 1e16."""
    digits = F.regexp_replace(F.regexp_replace(F.substring_index(found, "e", 1), r"\.", ""), "(?<=.)0+$", "")
    power = F.substring_index(found, "e", -1).try_cast("int")
    n = F.length(digits)
    fixed = (
        F.when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
        .when(power >= n - 1, F.concat(digits, F.repeat(F.lit("0"), power - n + 1), F.lit(".0")))
        .otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, n)))
    )
    sign = F.when(power < 0, "-").otherwise("+")
    point = F.when(n > 1, F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(digits)
    shown = F.abs(power).cast("string")
    exponent = F.concat(point, F.lit("e"), sign, F.lpad(shown, F.greatest(F.lit(2), F.length(shown)), F.lit("0")))
    return F.when((power >= -4) & (power < 16), fixed).otherwise(exponent)


def _escape(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(code), 4, "0")))


def string_text(s: Column, ascii_only: bool = True) -> Column:
    """A JSON string; ``ascii_only`` writes all other characters as escapes, those beyond 16 bits as pairs."""
    s = s.cast("string")

    def one(ch: Column) -> Column:
        code = F.ascii(ch).cast("long")
        known = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
        out = F
        for c, text in known.items():
            out = out.when(ch == c, text)
        out = out.when(code < 32, _escape(code))
        if ascii_only:
            pair = F.concat(_escape(0xD800 + F.shiftright(code - 0x10000, 10)), _escape(0xDC00 + (code - 0x10000).bitwiseAND(0x3FF)))
            out = out.when(code >= 0x10000, pair).when(code > 126, _escape(code))
        return out.otherwise(ch)

    plain = r"\A[ !#-\[\]-~]*\z" if ascii_only else r'\A[^"\\\x00-\x1f]*\z'
    body = F.when(s.rlike(plain), s).otherwise(F.array_join(F.transform(F.split(s, ""), one), ""))
    return F.concat(F.lit('"'), body, F.lit('"'))


def json_text(value: Column, kind: str, ascii_only: bool = True) -> Column:
    """The JSON of a value: ``kind`` is float, int, bool, string or json (JSON already); null is null."""
    text = {
        "float": lambda: float_text(value),
        "int": lambda: value.cast("bigint").cast("string"),
        "bool": lambda: F.lower(value.cast("string")),
        "string": lambda: string_text(value, ascii_only),
        "json": lambda: value,
    }[kind]()
    return F.coalesce(text, F.lit("null"))


def json_array(values: Column, kind: str, comma: str = ",", ascii_only: bool = True) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: json_text(v, kind, ascii_only)), comma), F.lit("]"))


def json_object(fields: dict[str, tuple[Column, str]], comma: str = ",", colon: str = ":", ascii_only: bool = True) -> Column:
    """An object of named (value, kind) with its keys in order; all keys are there, null or not."""
    parts = [F.concat(string_text(F.lit(k), ascii_only), F.lit(colon), json_text(v, kind, ascii_only)) for k, (v, kind) in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(comma, *parts), F.lit("}"))


#: Fixed value: the version of the crop that capture keys name.
CAPTURE_CONTRACT = "v2"


def capture_key(page_id: Column, viewport: Column, render_state: Column, box: Column) -> Column:
    """Twenty hex digits of the SHA-256 of the canonical JSON that names a crop."""
    said = json_object({"contract": (F.lit(CAPTURE_CONTRACT), "string"), "page_id": (page_id, "string"), "viewport": (viewport, "string"), "render_state": (render_state, "string"), "bbox": (json_array(box, "float"), "json")})
    return F.substring(F.sha2(said, 256), 1, 20)


def prediction_line(fields: dict[str, tuple[Column, str]]) -> Column:
    """A row of a predictions file: keys in order, spaces after commas and colons, text as it is."""
    return json_object(fields, ", ", ": ", ascii_only=False)
