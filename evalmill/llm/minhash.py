"""MinHash near-duplicates by a multi-index Hamming join.

A document's set of word shingles becomes a signature of ``chunks * width``
b-bit values.  Two signatures at a distance (differing values) of ``radius`` or
less have, by the pigeonhole principle, a chunk with ``radius // chunks`` errors
or fewer; each chunk is therefore indexed once for each set of that many
positions left out, and two such signatures share an index key for certain.

Pairs within a key are not all emitted.  In a few rounds each set is compared
with the nearest centre, within the radius, of those its keys draw (one order of
all sets draws them, so that one text's copies meet few), and sets linked so are
contracted to components.  Only keys that then still hold several components are
joined with themselves, on pairs of different components, each at the first key
that its two sets share.  There a pair must also agree in its rarest shingles:
of two sets that share ``need`` shingles or more, put in one order, the first
``size - need + k`` of each have ``k`` in common, so this loses no link.  Every
link that the index can show between two components is so checked, while a key
that holds thousands of copies of one text costs a few comparisons for each.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import written

CHUNKS, WIDTH, RADIUS, BITS = 12, 7, 23, 16
PLANES = 4  # bits of each value that the sketch holds
ROUNDS = 2  # of comparisons with one centre of each key, before all pairs of components left in a key
RARE = 8  # rarest shingles that the two sets of a pair must share in their prefixes
_CACHE = 1 << 17


class WordHashes(dict):
    """64-bit hashes of words, kept for the words met lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``n``-word shingles; fewer words make one shingle."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(n, len(words))
    m = len(words) - k + 1
    acc = h[:m].copy()
    for j in range(1, k):
        acc = (acc * np.uint64(0x9E3779B97F4A7C15)) ^ (acc >> np.uint64(29))
        acc += h[j : m + j]
    acc ^= acc >> np.uint64(32)
    acc *= np.uint64(0xD6E8FEB86659FD93)
    acc ^= acc >> np.uint64(32)
    return np.unique(acc)


def shingle_set(text: str | None, n: int) -> set:
    """The set itself, as tuples of words: what links are confirmed on."""
    words = words_of(text)
    if not words:
        return set()
    k = min(n, len(words))
    return set(zip(*(words[i:] for i in range(k))))


def _permutations(size: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_231)
    top = np.iinfo(np.int64).max
    return rng.integers(1, top, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, top, size, dtype=np.uint64)


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """One b-bit value for each permutation: the minimum's low-order mix."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):
        part = hashes[i : i + 2048, None] ^ b
        part *= a
        np.minimum(low, part.min(axis=0), out=low)
    low ^= low >> np.uint64(31)
    return ((low * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)).astype(">u2")


def sketch(sig: np.ndarray) -> list[int]:
    """The lowest bits of all values, plane by plane, in 64-bit words."""
    words = -(-len(sig) // 64)
    planes = [np.packbits((sig >> k) & 1).tobytes().ljust(8 * words, b"\0") for k in range(PLANES)]
    return np.frombuffer(b"".join(planes), "<i8").tolist()


_SIGNED = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("fp", pa.binary()), ("sig", pa.binary()), ("sketch", pa.list_(pa.int64()))])


def _signer(n: int, size: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        a, b = _permutations(size)
        for batch in batches:
            rows = {name: [] for name in _SIGNED.names}
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingle_hashes(text.as_py(), n, hashes)
                rows["id"].append(id_)
                rows["n"].append(len(s))
                if len(s):
                    sig = signature(s, a, b)
                    rows["fp"].append(xxhash.xxh128_digest(s.tobytes()))
                    rows["sig"].append(sig.tobytes())
                    rows["sketch"].append(sketch(sig))
                else:
                    for name in ("fp", "sig", "sketch"):
                        rows[name].append(None)
            yield pa.RecordBatch.from_pydict(rows, schema=_SIGNED)

    return sign


def _spreader(n: int):
    out = pa.schema([("fp", pa.binary()), ("shingle", pa.int64())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for text in batch.column(0):
                s = shingle_hashes(text.as_py(), n, hashes)
                if len(s):
                    yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh128_digest(s.tobytes())] * len(s), pa.binary()), pa.array(s.view(np.int64))], schema=out)

    return spread


def _rare_prefixes(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(fp, rare): the shingles of each set from the rarest on, as many as ``_share_rare`` may look at."""
    each = written(texts.mapInArrow(_spreader(n), "fp binary, shingle long"), "spread")
    often = each.groupBy("shingle").agg(F.count("*").alias("often"))
    ranked = each.join(often, "shingle").groupBy("fp").agg(F.array_sort(F.collect_set(F.struct("often", "shingle"))).alias("rare"))
    most = F.size("rare") - F.ceil(F.size("rare") * percent / 100) + RARE
    return written(ranked.select("fp", F.slice("rare", F.lit(1), most.cast("int"))["shingle"].alias("rare")), "rare")


def _share_rare(x: str, y: str, percent: int) -> F.Column:
    """Whether the prefixes of two sets share as many shingles as those of any linked pair do."""
    nx, ny = F.col(f"{x}n"), F.col(f"{y}n")
    need = F.ceil(percent * (nx + ny) / (100 + percent))
    k = F.least(F.lit(RARE), need)
    head = lambda s: F.slice(f"{s}rare", F.lit(1), F.greatest(F.lit(0), F.col(f"{s}n") - need + k).cast("int"))
    return F.size(F.array_intersect(head(x), head(y))) >= k


def index_keys(chunks: int, width: int, errors: int) -> F.Column:
    """All index keys of ``sig``: each chunk with each set of ``errors`` positions left out."""
    keys = []
    for c in range(chunks):
        for out in itertools.combinations(range(width), errors):
            spans, start = [], 0
            for p in (*out, width):
                if p > start:
                    spans.append(F.substring("sig", 2 * (c * width + start) + 1, 2 * (p - start)))
                start = p + 1
            keys.append(F.xxhash64(F.lit(c), F.lit(",".join(map(str, out))), *spans))
    return F.array(*keys)


def _verifier(n: int, percent: int):
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, set()
        for batch in batches:
            linked = []
            for ta, tb in zip(batch.column("ta"), batch.column("tb")):
                ta, tb = ta.as_py(), tb.as_py()
                if ta != last:
                    last, kept = ta, shingle_set(ta, n)
                other = shingle_set(tb, n)
                both = len(kept & other)
                linked.append(both > 0 and 100 * both >= percent * (len(kept) + len(other) - both))
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"), "linked": pa.array(linked, pa.bool_())}, schema=out)

    return verify


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int, name: str) -> DataFrame:
    """(a, b, linked) for candidate pairs, confirmed on the full shingle sets of both texts."""
    ta = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    tb = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    full = pairs.select("a", "b").join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb")
    return written(full.mapInArrow(_verifier(n, percent), "a long, b long, linked boolean"), name)


def _near(x: str, y: str, percent: int, size: int, reach: int) -> tuple[F.Column, F.Column]:
    """(sizes can be linked and signatures differ in ``reach`` values or fewer, how many differ).

    Values are compared by their lowest bits, which differ only where they do.
    """
    nx, ny, words = F.col(f"{x}n"), F.col(f"{y}n"), -(-size // 64)
    differ = lambda i: F.col(f"{x}sketch")[i].bitwiseXOR(F.col(f"{y}sketch")[i])
    distance = sum((F.bit_count(reduce(lambda p, q: p.bitwiseOR(q), (differ(k * words + w) for k in range(PLANES)))) for w in range(words)), F.lit(0))
    return (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & (distance <= reach), distance


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    percent: int = 80,
    chunks: int = CHUNKS,
    width: int = WIDTH,
    radius: int = RADIUS,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of ``docs``.

    Two documents are linked if ``100 * |A & B| >= percent * |A | B|`` for their
    sets of ``n``-word shingles; ``component_id`` is the smallest id reachable.

    Defined cases: null or empty texts, and texts of white space only, have no
    shingles and are linked with nothing.  Equal sets are one node of the graph,
    so any number of copies costs one signature entry.  Rows that repeat an id
    each get their own row, and those with shingles are one document: whatever is
    linked with one of their texts is linked with all.  A row without an id keeps
    a null component and is kept.  Other columns are ignored.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size, errors = chunks * width, radius // chunks
    share = percent / 100
    # beyond the radius as far as signatures of linked sets lie but once in some ten thousand
    reach = max(radius, math.ceil(size * (1 - share) + 4 * math.sqrt(size * share * (1 - share))))
    signed = written(src.mapInArrow(_signer(n, size), "id long, n long, fp binary, sig binary, sketch array<long>"), "signed")
    sets = signed.where("n > 0 and id is not null")
    classes = written(sets.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    first = classes.select("fp", F.col("rep").alias("id"))
    reps = written(sets.join(first, ["fp", "id"], "left_semi").select("id", "n", "fp", "sig", "sketch"), "reps")

    rows = reps.select("id", F.explode(index_keys(chunks, width, errors)).alias("key"))
    shared = rows.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("key")
    multi = written(rows.join(shared, "key").select("key", "id"), "multi")
    brief = reps.select("id", "n", "sketch")
    near, distance = _near("a", "b", percent, size, reach)
    within, _ = _near("a", "b", percent, size, radius)

    def described(pairs: DataFrame) -> DataFrame:
        side = lambda s: brief.select(F.col("id").alias(s), F.col("n").alias(s + "n"), F.col("sketch").alias(s + "sketch"))
        return pairs.join(side("a"), "a").join(side("b"), "b")

    def placed(labels: DataFrame | None) -> DataFrame:
        """The index with components, without keys that hold one component alone."""
        at = multi.withColumn("comp", F.col("id"))
        if labels is not None:
            at = multi.join(labels.select("id", F.col("root").alias("comp")), "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
        split = at.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("key")
        return written(at.join(split, "key"), "placed")

    labels, tried = None, None
    for salt in range(ROUNDS):  # each set with the nearest of the centres of its keys, new centres each time
        open_ = placed(labels)
        centre = open_.groupBy("key").agg(F.min(F.struct(F.xxhash64(F.lit(salt), "id"), F.col("id").alias("a"), F.col("comp").alias("acomp"))).alias("c"))
        pairs = open_.join(centre.select("key", "c.a", "c.acomp"), "key").where("comp <> acomp").select("a", F.col("id").alias("b")).distinct()
        best = described(pairs).where(within).groupBy("b").agg(F.min_by("a", F.struct(distance, F.col("a"))).alias("a"))
        best = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        best = best if tried is None else best.join(tried, ["a", "b"], "left_anti")
        got = _verified(best, src, n, percent, "tried")
        tried = got if tried is None else tried.union(got)
        labels = connected_components(tried.where("linked"))
    still = placed(labels)
    of_each = written(still.groupBy("id").agg(F.collect_set("key").alias("keys")).join(reps.select("id", "fp", "n", "sketch"), "id"), "of_each")
    rare = _rare_prefixes(src.join(of_each.select("id").distinct(), "id", "left_semi").select("text"), n, percent)
    opened = written(still.join(of_each.join(rare, "fp"), "id"), "open")
    side = lambda s: opened.select("key", *(F.col(c).alias(s + c) for c in ("id", "comp", "n", "sketch", "keys", "rare")))
    left, right = side("a"), side("b")
    first = F.array_min(F.array_intersect("akeys", "bkeys")) == left.key
    cross = left.join(right, (left.key == right.key) & (F.col("acomp") < F.col("bcomp")) & near & _share_rare("a", "b", percent) & first)
    cross = cross.select(F.least("aid", "bid").alias("a"), F.greatest("aid", "bid").alias("b")).distinct()
    cross = written(cross.join(tried, ["a", "b"], "left_anti"), "cross")
    more = _verified(cross, src, n, percent, "more")
    repeated = sets.groupBy("id").agg(F.min("fp").alias("f"), F.max("fp").alias("g")).where("f <> g").select("id")
    same = sets.join(repeated, "id").join(classes.select("fp", "rep"), "fp").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    links = tried.union(more).where("linked").select("a", "b").union(same)
    lab = connected_components(links).select(F.col("id").alias("rep"), "root")

    copies = classes.select("fp", "rep")
    out = signed.select("id", "n", "fp").join(copies, "fp", "left").join(lab, "rep", "left")
    comp = F.when(F.col("id").isNotNull(), F.coalesce("root", "rep", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.col("id").eqNullSafe(comp).alias("kept"))
