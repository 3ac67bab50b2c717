"""Secrets in texts: fixed forms by pattern, and other credential values by what they would cost to guess.

A value that stands behind a credential word is cut into words, dates, repeats,
keyboard walks and brute-force spans so that the guesses which an attacker needs
for all parts together are least; a dynamic program over the value's characters
finds that cut.  Values that stay dear are secrets, "password: required" is none.
"""

from __future__ import annotations

import json
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "guess")

# Fixed patterns of the three forms, and how long what they find has to be.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18}

#: What has to stand before a value for it to be tried: a credential word, a colon, equals sign or "is", and perhaps a quote.
CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|api[\x20_-]?key|(?:access|private|client|auth)[\x20_-](?:key|secret|token)|credentials?)["']?(?:\x20*[:=]{1,2}\x20*|\x20+is:?\x20+)["'`]?([^\s"'`<>]+)""",
    re.ASCII | re.IGNORECASE,
)
_HINTS = ("pass", "pwd", "pin", "secret", "token", "api", "key", "credential")
#: Guesses, as a power of two, from which a value is a secret; shorter values, and those of letters or of digits alone, are left to the fixed forms.
MIN_BITS, MIN_CHARS = 30.0, 6

SPAN_BITS = 1.0
_ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_SHIFTED = ('!@#$%^&*()_+', "QWERTYUIOP{}", 'ASDFGHJKL:"', "ZXCVBNM<>?")
_KEYS = {ch: (r, c) for rows in (_ROWS, _SHIFTED) for r, row in enumerate(rows) for c, ch in enumerate(row)}
_LEET = str.maketrans("43105$@7!", "aeiossati")
_REPEAT = re.compile(r"(.{1,4}?)\1{2,}", re.DOTALL)
_DATE = re.compile(r"(?=((?:19|20)\d\d))|(?=(\d{1,2}[-/.]\d{1,2}[-/.](?:\d{4}|\d\d)))|(?=((?:19|20)\d\d[-/.]\d{1,2}[-/.]\d{1,2}))|(?=(\d{8}|\d{6}))")


def _char_bits(ch: str) -> float:
    if ch in "0123456789":
        return math.log2(10)
    if "a" <= ch <= "z" or "A" <= ch <= "Z":
        return math.log2(26)
    return math.log2(33) if ch.isascii() else 7.0


def _date_bits(text: str) -> float | None:
    """Cost of a year, or of a day in any of the usual orders; None where it is none."""
    parts = re.split(r"[-/.]", text)
    if len(text) == 4:
        return math.log2(max(abs(int(text) - 2000), 20))
    if len(parts) == 1:
        cuts = [(text[:4], text[4:6], text[6:]), (text[4:], text[2:4], text[:2]), (text[4:], text[:2], text[2:4])] if len(text) == 8 else [(text[:2], text[2:4], text[4:]), (text[4:], text[2:4], text[:2]), (text[4:], text[:2], text[2:4])]
    elif len(parts[0]) == 4:
        cuts = [tuple(parts)]
    else:
        cuts = [(parts[2], parts[1], parts[0]), (parts[2], parts[0], parts[1])]
    years = []
    for y, m, d in cuts:
        year = int(y) if len(y) == 4 else 1900 + int(y) + 100 * (int(y) < 50)
        if 1900 <= year <= 2099 and 1 <= int(m) <= 12 and 1 <= int(d) <= 31:
            years.append(max(abs(year - 2000), 20))
    return math.log2(365 * min(years)) + 2.0 * (len(parts) > 1) if years else None


class GuessCost:
    """Least guesses for a value, as a power of two, and the cut that needs them."""

    def __init__(self, words: list[str]):
        """``words``: known words, commonest first."""
        self.ranks = {w: i for i, w in reversed(list(enumerate(words, 2)))}
        self.longest = max(map(len, words), default=0)

    def _words(self, value: str) -> Iterator[tuple[str, int, int, float]]:
        low = value.lower()
        if len(low) != len(value):  # a letter whose lower case is two
            low = "".join(c if len(x := c.lower()) != 1 else x for c in value)
        plain = low.translate(_LEET)
        for i in range(len(value)):
            for j in range(i + 3, min(len(value), i + self.longest) + 1):
                rank = self.ranks.get(plain[i:j])
                if rank is None:
                    continue
                as_is = value[i:j]
                changed = sum(a != b for a, b in zip(low[i:j], plain[i:j]))
                upper = sum("A" <= c <= "Z" for c in as_is)
                case = 0.0 if not upper else 1.0 if upper == 1 and "A" <= as_is[0] <= "Z" or upper == j - i - changed else math.log2(sum(math.comb(j - i, k) for k in range(1, min(upper, j - i - upper) + 1)) or 1) + 1
                yield "word", i, j, math.log2(rank) + case + changed

    def _runs(self, value: str) -> Iterator[tuple[str, int, int, float]]:
        for m in _REPEAT.finditer(value):
            yield "repeat", m.start(), m.end(), sum(map(_char_bits, m[1])) + math.log2((m.end() - m.start()) // len(m[1]))
        for m in _DATE.finditer(value):
            text = next(g for g in m.groups() if g)
            for cut in {len(text), 6, 4} if text.isdigit() else {len(text)}:
                if cut <= len(text) and (cut > 4 or text[:2] in ("19", "20")) and (bits := _date_bits(text[:cut])) is not None:
                    yield "date", m.start(), m.start() + cut, bits
        start, way, turns = 0, None, 0
        for i in range(1, len(value) + 1):
            a, b = _KEYS.get(value[i - 1]), _KEYS.get(value[i]) if i < len(value) else None
            step = (b[0] - a[0], b[1] - a[1]) if a and b else None
            if step is not None and step != (0, 0) and max(map(abs, step)) <= 1:
                turns, way = turns + (step != way), step
                continue
            if i - start >= 4:
                yield "walk", start, i, math.log2(len(_KEYS) / 2) + (i - start - 1) + (turns - 1) * math.log2(4.6)
            start, way, turns = i, None, 0

    def spans(self, value: str) -> list[tuple[str, int, int, float]]:
        """All known words, dates, and longest repeats and walks in ``value``, with their costs."""
        return [*self._words(value), *self._runs(value)]

    def segments(self, value: str) -> tuple[float, list[tuple[str, int, int]]]:
        """The least cost and its cut: of each span its own cost and SPAN_BITS; a brute-force span costs its characters."""
        ending = defaultdict(list)
        for kind, i, j, bits in self.spans(value):
            ending[j].append((kind, i, bits))
        best: list[tuple[float, str, int]] = [(0.0, "", 0)]  # cost, kind and start of the last span
        brute: tuple[float, int] = (math.inf, 0)  # cost and start of a brute-force span that ends here
        for j in range(1, len(value) + 1):
            own = _char_bits(value[j - 1])
            brute = min((brute[0] + own, brute[1]), (best[j - 1][0] + SPAN_BITS + own, j - 1))
            best.append(min([(brute[0], "brute", brute[1]), *((best[i][0] + SPAN_BITS + bits, kind, i) for kind, i, bits in ending[j])]))
        cut, j = [], len(value)
        while j:
            _, kind, i = best[j]
            cut.append((kind, i, j))
            j = i
        return best[-1][0], cut[::-1]


def fixed_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three fixed forms: leftmost and not overlapping within a form."""
    found = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def guess_spans(text: str, cost: GuessCost, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int, float]]:
    """Credential values that are dear to guess and overlap none of the spans in ``taken``."""
    low = text.lower()
    if not any(w in low for w in _HINTS):
        return []
    out, held, at = [], sorted((s, e) for _, s, e in taken), 0
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(".,;:!?)]}")
        start, end = m.start(1), m.start(1) + len(value)
        while at < len(held) and held[at][1] <= start:
            at += 1
        if any(s < end for s, e in held[at : at + 4] if e > start) or len(value) < MIN_CHARS or value.isdigit() or value.isalpha():
            continue
        bits, _ = cost.segments(value)
        if bits >= MIN_BITS:
            out.append(("guess", start, end, bits))
    return out


def vocabulary_words(path: str, mark: str = "</w>") -> list[str]:
    """Words of three letters and more that a tokenizer.json has as one piece, in the order of their ids: commonest first."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    whole = (p.removesuffix(mark) for p in sorted(vocab, key=vocab.__getitem__) if p.endswith(mark))
    return [w for w in whole if len(w) >= 3 and w.isalpha()]


_costs: dict[str, GuessCost] = {}
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())])


def _finder(path: str):
    out = pa.schema([("id", pa.int64()), ("spans", pa.list_(_SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _costs:
            _costs[path] = GuessCost(vocabulary_words(path))
        for batch in batches:
            spans = []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = fixed_spans(text)
                rows = [(*s, None) for s in base] + guess_spans(text, _costs[path], base)
                rows.sort(key=lambda s: (s[1], KINDS.index(s[0])))
                spans.append([dict(zip(("kind", "start", "end", "bits"), s)) for s in rows])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(_SPAN))], schema=out)

    return run


def find_secrets(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of each row: what looks like a secret, by start and kind, over whole texts.

    A span has a kind, start and end (code points, the end exclusive) and, where
    it was found by its guess cost, that cost in bits.  ``vocabulary`` names the
    tokenizer.json that lends its words.  Defined cases: null and empty texts
    have no spans; repeated and null ids each keep their row; an equal start is
    ordered by kind; other columns are ignored.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = src.mapInArrow(_finder(vocabulary), "id long, spans array<struct<kind: string, start: long, end: long, bits: double>>")
    return found.withColumnRenamed("id", id_col)
