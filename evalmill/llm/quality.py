"""Quality scores from compression: zstandard dictionaries of good and of bad text.

A text is compressed in blocks, each against both dictionaries.  The difference
of the two sizes over the text's length, drawn towards a typical value where the
text is short, is turned into a probability by a logistic fitted to rows that
neither dictionary has seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, labelled_sample, logistic

DICT_BYTES, BLOCK, LEVEL = 64 << 10, 512, 3
PER_CLASS = 4000  # labelled rows of a class to learn from
LEARN_BLOCKS = 8000  # blocks of a class to build a dictionary from, out of all blocks of half of those rows


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    slope: float
    offset: float
    pull: float
    typical: float
    block: int = BLOCK
    level: int = LEVEL

    def sizer(self):
        """Gives (size by the good dictionary, by the bad one, bytes) of a text."""
        if not self.good:
            return lambda text: (0, 0, 0)
        make = lambda d: zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
        good, bad, block = make(self.good), make(self.bad), self.block

        def sizes(text: str | None) -> tuple[int, int, int]:
            raw = (text or "").encode("utf-8", "surrogatepass")
            g = b = 0
            for i in range(0, len(raw), block):
                part = raw[i : i + block]
                g += len(good.compress(part))
                b += len(bad.compress(part))
            return g, b, len(raw)

        return sizes

    def scores(self, sizes: np.ndarray) -> np.ndarray:
        if not self.good:
            return np.full(len(sizes), self.offset)
        x = _difference(sizes, self.pull, self.typical)
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.offset, -30, 30)))


def _difference(sizes: np.ndarray, pull: float, typical: float) -> np.ndarray:
    """(bad size - good size) / length, with ``pull`` bytes of typical text added."""
    g, b, n = np.asarray(sizes, float).reshape(-1, 3).T
    return (b - g + pull * typical) / np.maximum(n + pull, 1)


def _size_rows(model: CompressionModel):
    schema = pa.schema([("y", pa.int32()), ("g", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = model.sizer()
        for batch in batches:
            got = np.array([sizes(t.as_py()) for t in batch.column("text")], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("y"), *(pa.array(got[:, i]) for i in range(3))], schema=schema)

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, eligible: F.Column | None = None, per_class: int = PER_CLASS, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> CompressionModel:
    """Learns from at most ``per_class`` labelled rows of either class.

    Half of them give the dictionaries: their whole texts are cut into blocks, and
    the ``LEARN_BLOCKS`` blocks of a class with the smallest hashes are taken,
    wherever in a text they stand.  The others, whole, give the calibration.
    Where a class has too little text for zstandard to choose from, the blocks
    themselves serve as its dictionary; where the other half holds one class
    alone, a standard slope serves.  Without text of both classes every score is
    the share of good rows, or 0.5.  An id with two labels counts as good.
    """
    eligible = F.lit(True) if eligible is None else eligible
    sample = labelled_sample(docs, labels, label, eligible, per_class, id_col, text_col)
    half = F.pmod(F.col("place"), F.lit(2)) == 0
    starts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / BLOCK).cast("int"))
    blocks = sample.where(half & (F.length("text") > 0)).select("y", "text", "place", F.explode(starts).alias("k"))
    blocks = blocks.select("y", F.substring("text", F.col("k") * BLOCK + 1, F.lit(BLOCK)).alias("block"), F.xxhash64("place", "k").alias("order"), "place", "k")
    by = {y: [r.block.encode() for r in blocks.where(F.col("y") == y).orderBy("order", "place", "k").limit(LEARN_BLOCKS).select("block").collect()] for y in (0, 1)}
    if not by[0] or not by[1]:
        share = sample.agg(F.avg("y")).first()[0]
        return CompressionModel(b"", b"", 0.0, 0.5 if share is None else float(share), 0.0, 0.0)
    dicts = {}
    for y, texts in by.items():
        try:
            dicts[y] = zstandard.train_dictionary(DICT_BYTES, texts, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            dicts[y] = b"".join(texts)[-DICT_BYTES:]
    draft = CompressionModel(dicts[1], dicts[0], 1.0, 0.0, 0.0, 0.0)
    got = sample.where(~half).select("text", "y").mapInArrow(_size_rows(draft), "y int, g long, b long, n long").toPandas()
    sizes, y = got[["g", "b", "n"]].to_numpy(), got["y"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        return CompressionModel(dicts[1], dicts[0], 20.0, 0.0, 64.0, 0.0)
    totals = labels.where(eligible & F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int").alias("y")).count().collect()
    count = {r.y: r["count"] for r in totals}
    typical = float(np.median(_difference(sizes, 0, 0)[y == 1]))
    best = None
    for pull in (0.0, 16.0, 32.0, 64.0, 128.0):
        slope, offset, loss = logistic(_difference(sizes, pull, typical), y)
        if best is None or loss < best[2]:
            best = slope, offset, loss, pull
    # the sample holds the classes in other shares than the labels do
    prior = np.log(max(count.get(1, 1), 1) / max(count.get(0, 1), 1)) - np.log(y.sum() / (len(y) - y.sum()))
    return CompressionModel(dicts[1], dicts[0], best[0], best[1] + float(prior), best[3], typical)


def _scorer(model: CompressionModel):
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = model.sizer()
        for batch in batches:
            got = np.array([sizes(t.as_py()) for t in batch.column("text")], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.scores(got))], schema=schema)

    return run


def quality_scores(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row, over whole texts; higher is likelier good.

    Defined cases: null and empty texts get the score of a typical text without
    evidence; repeated and null ids each keep their row; other columns are ignored.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_scorer(model), "id long, score double").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: CompressionModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns; only texts go to Python.

    Null and empty texts score as in ``quality_scores``; repeated rows and null ids each count.
    """

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sizes = model.sizer()
        for column in texts:
            yield pa.array(model.scores(np.array([sizes(t.as_py()) for t in column], np.int64).reshape(-1, 3)))

    return docs.where(score(F.col(text_col).cast("string")) >= threshold)


__all__ = ["CompressionModel", "fit_quality", "held_out", "keep_good", "quality_scores"]
