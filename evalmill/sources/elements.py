"""The elements of HTML pages as a table, made once from the source.

An element is one row: its number in document order (``node``), the largest
number inside it (``last``), its parent, tag, attributes with their places, and
the places of its tags in the source.  Another element lies inside it exactly if
its number is above ``node`` and at most ``last``, so questions about ancestors
are joins on intervals.  Places are code points, ends exclusive.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import dealt, written

# Fixed values of the language: elements without an end tag, those whose content is no markup, and what ends an open element of the same list.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
UNSEEN = frozenset("script style title template noembed noframes".split())
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_WITHIN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
_ENDERS = _ENDS_P | _ENDED_BY.keys()

_TOKEN = re.compile(r"<(?:!--(?:.*?)(?:-->|\Z)|[!?][^>]*>|/([A-Za-z][^\s/>]*)[^>]*>|([A-Za-z][^\s/>]*))", re.DOTALL)
_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+>""")
_ATTRIBUTE = re.compile(r"""\s*([^\s=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")

_ATTRS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_FIELDS = [(c, pa.int32()) for c in ("node", "last", "parent", "depth")] + [("tag", pa.string()), ("attrs", _ATTRS)]
_FIELDS += [(c, pa.int32()) for c in ("tag_start", "tag_end", "close_start", "close_end", "n_text")] + [("text", pa.string())]
_OUT = pa.schema([("row", pa.int64()), *_FIELDS])
KINDS = "row long, node int, last int, parent int, depth int, tag string, attrs array<struct<name: string, value: string, start: int, end: int>>, tag_start int, tag_end int, close_start int, close_end int, n_text int, text string"
_FLUSH = 20_000


def _attributes(source: str, start: int, end: int) -> list[dict]:
    found: dict[str, dict] = {}
    for m in _ATTRIBUTE.finditer(source, start, end):
        value = next((g for g in m.groups()[1:] if g is not None), "")
        found.setdefault(m[1].lower(), {"name": m[1].lower(), "value": html_lib.unescape(value), "start": m.start(), "end": m.end()})
    return list(found.values())


def scan(source: str) -> Iterator[list]:
    """The elements of one page in document order, as lists in the order of the table's fields.

    One pass with a stack.  End tags without a start are ignored; an element that is
    never closed ends where its parent does, or where the next of its kind begins.
    """
    rows: list[list] = []
    open_: list[list] = []
    names: Counter[str] = Counter()  # of the open elements
    texts: dict[int, list[str]] = {}
    seen = 0  # characters of text so far, white space and unseen elements apart
    at, limit, quotes, search = 0, source.rfind(">") + 1, True, _TOKEN.search

    def close(upto: int, start: int, end: int) -> None:
        while len(open_) > upto:
            row = open_.pop()
            names[row[4]] -= 1
            row[1], row[8], row[9], row[10] = len(rows) - 1, start, end if len(open_) == upto else start, seen - row[10]

    def add_text(upto: int) -> None:
        nonlocal seen
        words = html_lib.unescape(source[at:upto]).split()
        if words and open_:
            in_, tag = open_[-1][0], open_[-1][4]
            own = " ".join(words)
            texts.setdefault(in_, []).append(own)
            if tag not in UNSEEN:
                seen += len(own) - len(words) + 1

    while m := search(source, at, limit):
        begin = m.start()
        if at < begin:
            add_text(begin)
        at, (ended, name) = m.end(), m.groups()
        if ended:
            name = ended.lower()
            if names[name]:
                i = len(open_) - 1
                while open_[i][4] != name:
                    i -= 1
                close(i, begin, at)
        elif name:
            name, start = name.lower(), at
            if at < limit and source[at] == ">":
                at, attrs = at + 1, []
            else:
                rest = _REST.match(source, at, limit) if quotes else None
                if rest is None:
                    quotes = False  # a quote that nothing closes: from here on, a tag ends at its first bracket
                at = rest.end() if rest else source.index(">", at, limit) + 1
                attrs = _attributes(source, start, at - 1)
            if name in _ENDERS:
                _implied(name, open_, names, lambda upto: close(upto, begin, begin))
            row = [len(rows), 0, open_[-1][0] if open_ else -1, len(open_), name, attrs, begin, at, at, at, seen, None]
            rows.append(row)
            if name in VOID:
                row[1], row[10] = row[0], 0
                continue
            open_.append(row)
            names[name] += 1
            if name in RAW:
                end = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.IGNORECASE).search(source, at)
                stop = end.start() if end else len(source)
                add_text(stop)
                after = source.find(">", stop) + 1 if end else stop
                close(len(open_) - 1, stop, after or len(source))
                at = after or len(source)
    add_text(len(source))
    close(0, len(source), len(source))
    for row in rows:
        row[11] = " ".join(texts.get(row[0], ()))
        yield row


def _implied(name: str, open_: list[list], names: Counter[str], close) -> None:
    """Ends what the start tag of ``name`` ends without an end tag."""
    if name in _ENDS_P:
        ended, within = {"p"}, {"button", "table", "td", "th", "body", "html"}
    elif name in _ENDED_BY:
        ended, within = _ENDED_BY[name], _WITHIN[name]
    else:
        return
    if not any(names[n] for n in ended):
        return
    for i in range(len(open_) - 1, -1, -1):
        if open_[i][4] in ended:
            close(i)
            if name != "tr":
                return
        elif open_[i][4] in within:
            return


def _scanner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows), _OUT)], schema=_OUT)

    held: list[list] = []
    for pages in batches:
        whole = pages.num_columns == 2
        asked = repeat((None, None)) if whole else zip(pages.column(2).to_pylist(), pages.column(3).to_pylist())
        for key, source, (node, tags) in zip(pages.column(0).to_pylist(), pages.column(1), asked):
            for row in scan(source.as_py() or ""):
                if whole or row[0] <= node <= row[1] or row[4] in tags:
                    held.append([key, *row])
                if len(held) >= _FLUSH:
                    yield batch(held)
                    held = []
    if held:
        yield batch(held)


def numbered_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages written once with a ``row`` of their own, so that pages that repeat an id, or have none, stay apart.

    They are dealt into many files: pages pack well, and one file would be the
    work of one task, however long it takes to scan.
    """
    rows = pages.withColumn("row", F.monotonically_increasing_id()).withColumn(html, F.coalesce(F.col(html).cast("string"), F.lit("")))
    return written(dealt(rows, "row"), "pages")


def element_table(numbered: DataFrame, html: str = "html", text: bool = True, near: tuple[Column, Column] | None = None) -> DataFrame:
    """All elements of :func:`numbered_pages`, written once; without ``text``, by far the largest column, where it is not read.

    ``near`` is a node and an array of tags for each page: where one element of a
    page is asked about, what it is in, itself, and the elements of those tags
    are kept.  The page is scanned whole, so their numbers are the same.

    Defined cases: a page without elements has no rows; a broken page has those
    that can be read; of repeated attributes the first counts, as in a browser;
    the content of scripts and the like holds no elements.  ``text`` is what
    stands directly in the element, ``n_text`` counts the characters of all text
    inside it, white space and scripts apart.
    """
    rows = numbered.select("row", html, *(c.alias(name) for c, name in zip(near or (), ("near", "tags")))).mapInArrow(_scanner, KINDS)
    return written(rows if text else rows.drop("text"), "elements")


def attribute(name: str, field: str = "value") -> Column:
    """A field of an element's attribute; null where it has none of that name."""
    return F.get(F.filter("attrs", lambda a: a["name"] == name), F.lit(0))[field]


def declared(name: str, style: Column | None = None) -> Column:
    """What an element's own ``style`` says of a property, the last time it names it; null where it doesn't."""
    style = F.lower(attribute("style")) if style is None else style
    value = F.regexp_extract(F.concat(F.lit(";"), style), rf"^.*;\s*{name}\s*:\s*([^;]*?)\s*(?:!\s*important\s*)?(?:;|$)", 1)
    return F.when(value != "", value)
