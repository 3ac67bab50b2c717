"""Main text of web pages, by paths that the pages of a host agree on.

Each page scores its containers by their share of the page's running text and
votes for the path of its best one (tags and classes from the root, digits made
alike).  Votes are counted in Spark for each host and path, and each kind of page
(host, and paths at or below the best one) is given the path of its own with most
votes.  Pages are then read again for the text below that path; a path that no
page voted for never wins, and a page's own best always has its own vote.

Paths are 64-bit hashes, each made from the hash of the path above and one step,
so reading a page takes time and memory in proportion to its length.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .shared import written

#: What HTML reads as text up to its end tag, or the end of the page.
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_OPENING = re.compile(r"<(?:(!--)|(/?)([a-z][^\s/>]*)|[!?/])", re.I)
_ENDS_OF_TAG = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CONTAINERS = {"article": 1.5, "main": 1.3, "section": 1.0, "div": 1.0, "td": 1.0, "center": 1.0, "body": 0.8, "#root": 0.7}
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup "
    "hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
_DROPPED = frozenset("aside button datalist dialog fieldset footer form head header input label menu nav option select audio video canvas object noscript template svg".split())
_DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
_DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus footer header login masthead "
    "menu modal nav navbar navigation newsletter notice notices popup promo promoted related replies respond share sharing sidebar signup skip social sponsor sponsored "
    "subscribe toolbar widget".split()
)
_KEPT_WORDS = frozenset("article body content entry main page post story text".split())
_COMMENT_WORDS = frozenset("comment comments discussion disqus replies respond".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_AT = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Start tags that end an svg element left open, beside blocks.
_BREAKS_SVG = _BLOCKS - {"title"} | frozenset("b big br code em embed i img meta nobr ruby s small span strong strike sub sup tt u var".split())


class Node:
    __slots__ = ("chars", "dropped", "parent", "path", "depth", "tag", "inside")

    def __init__(self, tag: str, path: int, depth: int, parent: Node | None, dropped: bool):
        self.tag, self.path, self.depth, self.parent, self.dropped, self.chars, self.inside = tag, path, depth, parent, dropped, 0, False


def _described(tag: str, attributes: str) -> tuple[str, bool]:
    """The path step of an element, and whether it is none of the article."""
    dropped, key = tag in _DROPPED, tag
    if not attributes.strip():
        return key, dropped
    found = {name.lower(): a or b or c for name, a, b, c in _ATTRIBUTE.findall(attributes)}
    classes = sorted({re.sub(r"\d+", "#", c) for c in found.get("class", "").lower().split()})
    if classes:
        key += "." + ".".join(classes)
    words = set(re.split(r"[^a-z]+", f"{found.get('class', '')} {found.get('id', '')}".lower()))
    if tag in ("article", "main", "body", "html"):
        dropped = dropped or tag == "article" and bool(words & _COMMENT_WORDS)
    elif words & _DROPPED_WORDS and (not words & _KEPT_WORDS or words & _COMMENT_WORDS):
        dropped = True
    hidden = "hidden" in found and found["hidden"].lower() != "until-found" or found.get("aria-hidden", "").lower() == "true"
    hidden = hidden or re.search(r"display\s*:\s*none", found.get("style", ""), re.I) is not None
    return key, dropped or hidden or found.get("role", "").lower() in _DROPPED_ROLES


def tags_of(html: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, end tag?, name, attributes) of each tag; name is empty for comments and the like.

    A quote opens a value only after an equals sign; one that is never closed ends with its tag.
    """
    at, none_left = 0, set()

    def find(what: str, start: int) -> int:
        if what in none_left:
            return -1
        if (found := html.find(what, start)) < 0:
            none_left.add(what)
        return found

    while (m := _OPENING.search(html, at)) is not None:
        start, at = m.start(), m.end()
        if m[1]:
            end = html.find(">", at, at + 2) if html.startswith((">", "->"), at) else find("-->", at)
            at = len(html) if end < 0 else end + (1 if html[end] == ">" else 3)
            yield start, at, False, "", ""
            continue
        if not m[3]:
            end = find(">", at)
            at = len(html) if end < 0 else end + 1
            yield start, at, False, "", ""
            continue
        name, end = m[3].lower(), at
        while (q := _ENDS_OF_TAG.search(html, end)) is not None and q[0] != ">":
            before = q.start() - 1
            while before > at and html[before].isspace():
                before -= 1
            close = find(q[0], q.end()) if html[before] == "=" else q.start()
            end = q.end() if close < 0 else close + 1
        stop = len(html) if q is None else q.start()
        yield start, min(stop + 1, len(html)), bool(m[2]), name, html[at:stop]
        at = min(stop + 1, len(html))
        if name in _RAW and not m[2]:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
            if end is None:
                yield at, len(html), False, "", ""
                return
            if end.start() > at:
                yield at, end.start(), False, "", ""
            at = end.start()


def _never_closed(tags: list[tuple]) -> set[int]:
    """Places in ``tags`` of start tags of dropped elements that have no end tag: they hold nothing."""
    ends, out = Counter(), set()
    for i in range(len(tags) - 1, -1, -1):
        _, _, closing, name, _ = tags[i]
        if name in _DROPPED and name not in _VOID:
            if closing:
                ends[name] += 1
            elif ends[name]:
                ends[name] -= 1
            else:
                out.add(i)
    return out


def read_page(html: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """(nodes from the root on, blocks of text with their node), in page order."""
    root = Node("#root", 0, 0, None, False)
    stack, nodes, blocks = [root], [root], []
    opened: Counter = Counter()  # tags on the stack
    parts: list[str] = []
    linked = length = 0  # characters of the block, and those of them in links
    at = 0

    def flush() -> None:
        nonlocal linked, length
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                blocks.append((stack[-1], text))
                if linked < 0.5 * length:
                    stack[-1].chars += len(text)
            parts.clear()
        linked = length = 0

    def pop_to(index: int, always: bool = True) -> None:
        if always or any(n.tag in _BLOCKS or n.dropped != stack[index - 1].dropped for n in stack[index:]):
            flush()
        for n in stack[index:]:
            opened[n.tag] -= 1
        del stack[index:]

    tags = list(tags_of(html))
    empty = _never_closed(tags)
    for number, (start, end, closing, tag, attributes) in enumerate(tags):
        if start > at and not stack[-1].dropped:
            piece = html[at:start]
            parts.append(piece)
            size = len(piece.strip())
            length += size
            linked += size if opened["a"] else 0
        at = end
        if not tag:
            continue
        if closing:
            if opened[tag]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        pop_to(i, tag in _BLOCKS)
                        break
            continue
        if tag in _BREAKS_SVG and opened["svg"] and not opened["foreignobject"]:
            pop_to(next(i for i, n in enumerate(stack) if n.tag == "svg"))
        if tag in _VOID:
            parts.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag in _BLOCKS:
            flush()
            closes, ends = _CLOSES.get(tag, ()), _ENDS_AT.get(tag, ())
            if opened["p"] or any(opened[c] for c in closes):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p" or stack[i].tag in closes:
                        pop_to(i)
                        if tag not in closes and tag not in _CLOSES:
                            break
                    elif stack[i].tag in ends or stack[i].tag in _CONTAINERS or stack[i].tag in ("table", "blockquote"):
                        break
        if number in empty or (attributes.endswith("/") and tag not in _BLOCKS):
            continue
        key, dropped = _described(tag, attributes)
        above = stack[-1]
        if dropped and not above.dropped:
            flush()
        step = tag in _BLOCKS
        path = xxhash.xxh64_intdigest(key, above.path) if step else above.path
        node = Node(tag, path, above.depth + step, above, dropped or above.dropped)
        stack.append(node)
        opened[tag] += 1
        nodes.append(node)
    if at < len(html) and not stack[-1].dropped:
        parts.append(html[at:])
        length += len(html) - at
    flush()
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.chars += node.chars
    return nodes, blocks


def candidate_paths(nodes: list[Node]) -> list[int]:
    """The path of the page's best container, then the others at or below it that hold running text, by depth.

    A path scores as the best of its containers: the share of running text below it, by
    kind of element.  Of equal scores the deeper path wins, and of those the first one.
    """
    total = nodes[0].chars
    best, own = (0.0, 0), nodes[0].path
    for node in nodes if total else ():
        if node.tag in _CONTAINERS and not node.dropped:
            score = round(_CONTAINERS[node.tag] * node.chars / total, 6)
            if score > 0.1 and (score, node.depth) > best:
                best, own = (score, node.depth), node.path
    found: dict[int, int] = {}
    for node in nodes:
        node.inside = node.path == own if node.parent is None else node.parent.inside or (node.path == own and node.tag in _CONTAINERS)
        if node.inside and node.chars and node.tag in _CONTAINERS and not node.dropped:
            found.setdefault(node.path, node.depth)
    return [own, *sorted((path for path in found if path != own), key=found.__getitem__)]


def text_below(html: str | None, path: int | None) -> str:
    """The blocks below the containers of ``path``, or below the page's own best where it is None."""
    if not html:
        return ""
    nodes, blocks = read_page(html)
    if path is None:
        path = candidate_paths(nodes)[0]
    for node in nodes:
        node.inside = node.path == path if node.parent is None else node.parent.inside or (node.path == path and node.tag in _CONTAINERS)
    return "\n".join(text for node, text in blocks if node.inside)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@F.arrow_udf(ArrayType(LongType()))
def _candidates(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in pages:
        yield pa.array([[_signed(p) for p in candidate_paths(read_page(html.as_py() or "")[0])] for html in column], pa.list_(pa.int64()))


def _extractor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    for batch in batches:
        texts = [text_below(html.as_py(), None if path is None else path % (1 << 64)) for html, path in zip(batch.column("html"), batch.column("path").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)


def host_of(url: str) -> F.Column:
    """Host of a URL in lower case, without user and port; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _with_paths(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return src.withColumn("host", host_of("url")).withColumn("paths", _candidates("html"))


def consensus_paths(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, paths, path, votes): for each kind of page, its path with most votes of the host.

    ``paths`` are the page's own best and those below.  Each page votes once, for
    its best; of equal votes the deeper path wins.  No path and no host is left out.
    """
    kinds = written(_with_paths(pages, id_col, url_col, html_col).groupBy("host", "paths").agg(F.count("*").alias("pages")), "kinds")
    votes = kinds.groupBy("host", F.col("paths")[0].alias("path")).agg(F.sum("pages").alias("votes"))
    each = kinds.select("host", "paths", F.posexplode("paths").alias("pos", "path")).join(votes, ["host", "path"])
    best = F.max(F.struct("votes", "pos", "path")).alias("best")
    return each.groupBy("host", "paths").agg(best).select("host", "paths", "best.path", "best.votes")


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages``, from its whole html.

    Blocks are joined in page order by one line feed; white space inside a block
    is one space; character references are decoded.  Defined cases: null and
    empty html, and pages without text, give an empty text; a null or
    odd url votes with the others that have no host; repeated and null ids each
    keep their row; dropped elements without an end tag hold nothing; other
    columns are ignored.
    """
    chosen = written(consensus_paths(pages, id_col, url_col, html_col).select("host", "paths", "path"), "consensus")
    joined = _with_paths(pages, id_col, url_col, html_col).join(chosen, ["host", "paths"], "left")
    out = joined.select("page_id", "url", "html", "path").mapInArrow(_extractor, "page_id long, url string, text string, n_chars long")
    return out.withColumnRenamed("page_id", id_col).withColumnRenamed("url", url_col)
