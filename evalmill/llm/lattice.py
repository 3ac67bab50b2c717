"""Embedding near-duplicates by E8 lattice hashing.

A vector is projected at random to blocks of eight dimensions, each block is
decoded to its nearest point of the lattice E8, and the points of a table's
blocks are the vector's cell.  Besides its own cell a vector probes neighbours:
for each block the lattice points next nearest to the projection.  Two vectors
meet in a table if the own cell of one is among the cells of the other.

A cell's vectors are compared in blocks of bounded size with exact cosines.  A
pair that meets in several tables counts in the first alone, so numbers of links
add up over tasks, and a block gives only sums and a spanning forest of its
links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import written

TABLES, BLOCKS, SCALE, PROBES = 8, 2, 1.5, 8
BLOCK_ROWS = 512


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    f = np.rint(x)
    odd = (f.sum(axis=-1) % 2) != 0
    gap = x - f
    at = np.abs(gap).argmax(axis=-1)
    rows = np.arange(len(x))
    up = np.where(gap[rows, at] >= 0, 1.0, -1.0)
    f[rows[odd], at[odd]] += up[odd]
    return f


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8 = D8 and D8 + 1/2, for rows of eight numbers."""
    a = nearest_d8(x)
    b = nearest_d8(x - 0.5) + 0.5
    closer = ((x - b) ** 2).sum(axis=-1) < ((x - a) ** 2).sum(axis=-1)
    return np.where(closer[:, None], b, a)


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i in range(8):
        for j in range(i):
            for s in (1.0, -1.0):
                for t in (1.0, -1.0):
                    v = np.zeros(8)
                    v[i], v[j] = s, t
                    out.append(v)
    for bits in range(256):
        signs = np.array([1 - 2 * (bits >> k & 1) for k in range(8)])
        if signs.prod() > 0:
            out.append(signs / 2)
    return np.array(out)


class Hasher:
    """Own cells and probed cells of unit vectors."""

    def __init__(self, dim: int, tables: int = TABLES, blocks: int = BLOCKS, scale: float = SCALE, probes: int = PROBES, seed: int = 11):
        rng = np.random.default_rng([seed, dim])
        width = 8 * blocks
        self.tables, self.blocks, self.probes = tables, blocks, probes
        planes = []
        for _ in range(tables):  # orthonormal rows where there are enough dimensions
            g = rng.normal(size=(dim, width))
            planes.append(np.linalg.qr(g)[0] if dim >= width else g / np.sqrt(dim))
        self.planes = np.stack(planes) * scale * np.sqrt(dim / 8 if dim >= width else 1)
        self.shift = rng.random((tables, width))
        self.near = minimal_vectors()
        self.mix = rng.integers(1, 2**62, (tables, width), dtype=np.int64) * 2 + 1

    def keys(self, unit: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(own, probed): 64-bit keys (rows, tables) and (rows, tables, probes); base sets labels apart."""
        n = len(unit)
        own = np.empty((n, self.tables), np.int64)
        probed = np.empty((n, self.tables, self.probes), np.int64)
        for t in range(self.tables):
            x = (unit @ self.planes[t] + self.shift[t]).reshape(n, self.blocks, 8)
            point = nearest_e8(x.reshape(-1, 8)).reshape(n, self.blocks, 8)
            weights = self.mix[t].reshape(self.blocks, 8)
            with np.errstate(over="ignore"):
                key = ((2 * point).astype(np.int64) * weights).sum(axis=(1, 2)) + base + t
                own[:, t] = key
                # moving one block to a neighbour at distance v costs |v|^2 - 2 v.(x - point); the cheapest come first
                gain = (x - point) @ self.near.T
                cheap = np.argpartition(-gain.reshape(n, -1), self.probes, axis=1)[:, : self.probes]
                block, v = cheap // len(self.near), cheap % len(self.near)
                step = ((2 * self.near).astype(np.int64) @ weights.T)[v, block]
                probed[:, t, :] = key[:, None] + step
        return own, probed


def _unit(values: list | None) -> np.ndarray | None:
    """The vector over its length in double precision; None where it has no direction."""
    if values is None or not len(values) or any(v is None for v in values):
        return None
    v = np.asarray(values, np.float64)
    if not np.isfinite(v).all():
        return None
    top = np.abs(v).max()
    if top == 0:
        return None
    v = v / top
    return v / np.sqrt(v @ v)


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("fp", pa.binary()), ("label", pa.string()), ("unit", pa.binary())])
    for batch in batches:
        ids, labels = batch.column("id").to_pylist(), batch.column("label").to_pylist()
        rows: dict[str, list] = {n: [] for n in schema.names}
        for id_, label, values in zip(ids, labels, batch.column("embedding").to_pylist()):
            unit = _unit(values) if label is not None and id_ is not None else None
            raw = None if unit is None else unit.tobytes()
            for k, v in zip(schema.names, (id_, raw and xxhash.xxh128_digest(label.encode() + b"\0" + raw), label, raw)):
                rows[k].append(v)
        yield pa.RecordBatch.from_pydict(rows, schema=schema)


def _hash_rows(tables: int, blocks: int, scale: float, probes: int):
    schema = pa.schema([("rep", pa.int64()), ("copies", pa.int64()), ("unit", pa.binary()), ("own", pa.list_(pa.int64())), ("key", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers: dict[int, Hasher] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            units, labels = batch.column("unit").to_pylist(), batch.column("label").to_pylist()
            own_of, keys_of = [None] * len(units), [None] * len(units)
            sizes = np.array([len(u) // 8 for u in units])
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                h = hashers.setdefault(int(dim), Hasher(int(dim), tables, blocks, scale, probes))
                base = np.array([xxhash.xxh64_intdigest(labels[i].encode(), int(dim)) for i in at], np.uint64).view(np.int64)
                own, probed = h.keys(np.frombuffer(b"".join(units[i] for i in at)).reshape(len(at), dim), base)
                for k, i in enumerate(at):
                    own_of[i] = own[k].tolist()
                    keys_of[i] = [*own_of[i], *probed[k].reshape(-1).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("copies"), batch.column("unit"), pa.array(own_of, schema.field("own").type), pa.array(keys_of, schema.field("key").type)], schema=schema)

    return run


def _first_meeting(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], tables: int) -> np.ndarray:
    """The first cell that holds both vectors of each pair and is the own cell of one of them.

    Both are (own, all) keys, a those of the smaller id; all has the own keys
    first, then the probed ones, table by table.
    """
    (own_a, all_a), (own_b, all_b) = a, b
    probes = all_a.shape[1] // tables - 1
    done, where = np.zeros(len(own_a), bool), np.zeros(len(own_a), np.int64)
    for t in range(tables):
        at = slice(tables + t * probes, tables + (t + 1) * probes)
        for own, same, probed in ((own_a[:, t], own_b[:, t], all_b[:, at]), (own_b[:, t], own_a[:, t], all_a[:, at])):
            new = ~done & ((own == same) | (probed == own[:, None]).any(axis=1))
            where[new] = own[new]
            done |= new
    return where


def _links_of(cell: int, same: bool, rep: np.ndarray, copies: np.ndarray, side: np.ndarray, unit: np.ndarray, own: np.ndarray, keys: np.ndarray, threshold: float, tables: int):
    """(rep, links, root) of the vectors of one unit of work; None without links."""
    linked = unit @ unit.T >= threshold
    owner = (own == cell).any(axis=1)
    linked &= owner[:, None] | owner[None, :]
    linked &= rep[:, None] < rep[None, :]
    if not same:
        linked &= side[:, None] != side[None, :]
    x, y = np.nonzero(linked)
    keep = np.concatenate([_first_meeting((own[x[i : i + 4096]], keys[x[i : i + 4096]]), (own[y[i : i + 4096]], keys[y[i : i + 4096]]), tables) == cell for i in range(0, len(x), 4096)]) if len(x) else x.astype(bool)
    x, y = x[keep], y[keep]
    if not len(x):
        return None
    links = np.bincount(x, copies[y], len(rep)) + np.bincount(y, copies[x], len(rep))
    order = np.argsort(rep)
    root = np.empty(len(rep), np.int64)
    root[order] = np.arange(len(rep))
    by_rank = rep[order]
    while True:  # the smallest linked rank, until nothing changes
        low = root.copy()
        np.minimum.at(low, x, root[y])
        np.minimum.at(low, y, root[x])
        low = np.minimum(low, low[order][low])
        if (low == root).all():
            break
        root = low
    with_links = links > 0
    return rep[with_links], links[with_links].astype(np.int64), by_rank[root[with_links]]


def _comparer(threshold: float, tables: int):
    """Over rows sorted by (cell, i, j); a unit of work may go on in the next batch."""
    schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def results(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            rows = rows.combine_chunks()
            col = {c: rows[c].to_numpy() for c in ("cell", "i", "j", "side", "rep", "copies")}
            flat = lambda c: (rows[c].chunk(0) if rows[c].num_chunks else rows[c]).flatten().to_numpy().reshape(rows.num_rows, -1)
            own, keys, units = flat("own"), flat("key"), rows["unit"].to_pylist()
            new = np.flatnonzero(np.concatenate([[True], (np.diff(col["cell"]) != 0) | (np.diff(col["i"]) != 0) | (np.diff(col["j"]) != 0)]))
            found = []
            for s, e in zip(new, [*new[1:], rows.num_rows]):
                if e - s < 2:
                    continue
                unit = np.frombuffer(b"".join(units[s:e])).reshape(e - s, -1)
                got = _links_of(col["cell"][s], col["i"][s] == col["j"][s], col["rep"][s:e], col["copies"][s:e], col["side"][s:e], unit, own[s:e], keys[s:e], threshold, tables)
                if got is not None:
                    found.append(got)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            last = [rows[c][rows.num_rows - 1].as_py() for c in ("cell", "i", "j")]
            same = np.logical_and.reduce([rows[c].to_numpy() == v for c, v in zip(("cell", "i", "j"), last)])
            cut = rows.num_rows - int(same.sum())  # the last unit waits for the next batch
            if cut:
                yield from results(rows.slice(0, cut))
            held = rows.slice(cut)
        if held is not None:
            yield from results(held)

    return run


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    tables: int = TABLES,
    blocks: int = BLOCKS,
    scale: float = SCALE,
    probes: int = PROBES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of ``vectors``.

    Vectors of the same label whose cosine, in double precision, is at least
    ``threshold`` are linked where the lattice tables bring them together (at a
    cosine of 0.93 that misses about one pair in two hundred; see the README).
    Defined cases: vectors that are null, empty or zero or hold null or
    non-finite numbers, and rows without a label or an id, are linked with
    nothing; vectors of other lengths are never compared; equal vectors are one
    node with a number of copies, each linked to the others; rows that repeat an
    id each count as a vector and are in one component.  Other columns are
    ignored.
    """
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).cast("string").alias("label"))
    ready = written(src.mapInArrow(_prepare, "id long, fp binary, label string, unit binary"), "units")
    classes = ready.where("fp is not null").groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("unit").alias("unit"))
    # A class is known by a number of its own: an id that is repeated may be the first of several classes.
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    hashed = classes.select("rep", "copies", "label", "unit").mapInArrow(_hash_rows(tables, blocks, scale, probes), "rep long, copies long, unit binary, own array<long>, key array<long>")
    hashed = written(hashed, "cells")
    thin = hashed.select("rep", F.posexplode("key").alias("pos", "cell"))
    counts = thin.groupBy("cell").agg(F.count("*").alias("n"), F.max((F.col("pos") < tables).cast("int")).alias("owned")).where("n > 1 and owned = 1").select("cell", "n")
    parts = F.ceil(F.col("n") / block_rows).cast("int")
    members = thin.join(counts, "cell").select("rep", "cell", parts.alias("parts"), F.pmod(F.xxhash64("rep"), parts).cast("int").alias("side"))
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least("side", p).alias("i"), F.greatest("side", p).alias("j"))))
    work = members.select("rep", "cell", "side", pairs.alias("at")).select("rep", "cell", "side", "at.i", "at.j")
    full = work.join(hashed, "rep").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    found = written(full.select("cell", "i", "j", "side", "rep", "copies", "unit", "own", "key").mapInArrow(_comparer(threshold, tables), "rep long, links long, root long"), "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    # Components are those of ids: each class by its first id, and each id that stands in more than one row by all its classes.
    ends = classes.select(F.col("rep").alias("root"), F.col("first").alias("b"))
    met = found.select("rep", "root").distinct().join(classes.select("rep", F.col("first").alias("a")), "rep").join(ends, "root").select("a", "b")
    repeated = ready.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    own = ready.where("fp is not null").join(repeated, "id", "left_semi").join(classes, "fp").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    roots = connected_components(met.union(own), "a", "b").select(F.col("id").alias("first"), "root")
    per_class = classes.select("fp", "rep", "first", "copies").join(links, "rep", "left").join(roots, "first", "left")
    with_class = ready.where("fp is not null").select("id", "fp").join(per_class, "fp").select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "first").alias("root"))
    alone = ready.where("fp is null").select("id").join(roots.withColumnRenamed("first", "id"), "id", "left").select("id", F.lit(0).cast("long").alias("n_links"), F.coalesce("root", "id").alias("root"))
    out, comp = with_class.union(alone), F.col("root")
    return out.select(F.col("id").alias(id_col), "n_links", comp.alias("component_id"), F.col("id").eqNullSafe(comp).alias("kept"))
