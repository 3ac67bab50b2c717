"""Benchmark decontamination: BM25 over test items, searched by block-max WAND.

The index of the items is built in Spark: terms are word pairs, weighted by BM25
and divided by the score that the item gives itself, so 1 means that a passage
holds all of an item.  Items are indexed by length: those of up to 64 words, of
up to 128, and so on.  Every training text is cut into passages that overlap by
half and are twice as long as the items of an index may be; each is a query, and
all items at the threshold or above are retrieved.  An item's passages depend on
its own length alone, so other items never change whether it is found.  A hit stands if the passage also holds
enough of the item's question and of its answer, in longer word sequences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP, SEQUENCE = 0.5, 0.6, 5
SHORTEST, BLOCK = 64, 16  # words of the first length class; postings of a block
POSTINGS_OF_PASS = 200_000  # word pairs of the items that one reading of the documents looks for
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of an item without its last sentence, and of that sentence; one sentence is all question."""
    parts = [w for w in (words_of(s) for s in _SENTENCE.split(text)) if w]
    if len(parts) < 2:
        return (parts[0] if parts else []), []
    return [w for p in parts[:-1] for w in p], parts[-1]


def _sequences(words: list[str], n: int = SEQUENCE) -> set[tuple]:
    n = min(n, len(words))
    return set(zip(*(words[i:] for i in range(n)))) if n else set()


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("item_id", pa.int64()), ("first", pa.string()), ("second", pa.string()), ("tf", pa.int64()), ("length", pa.int64())])
    for batch in batches:
        rows: list[tuple] = []
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
            words, count = words_of(text), {}
            for pair in zip(words, words[1:]):
                count[pair] = count.get(pair, 0) + 1
            rows += [(item, a, b, n, len(words) - 1) for (a, b), n in count.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def item_postings(items: DataFrame) -> DataFrame:
    """(item_id, first, second, weight): BM25 weights of word pairs, summing to 1 for each item."""
    tf = written(items.mapInArrow(_terms, "item_id long, first string, second string, tf long, length long"), "terms")
    total = tf.select("item_id", "length").distinct().agg(F.count("*").alias("items"), F.avg("length").alias("mean"))
    df = tf.groupBy("first", "second").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("items") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = tf.join(df, ["first", "second"]).join(F.broadcast(total)).select("item_id", "first", "second", (idf * gain).alias("score"))
    own = scored.groupBy("item_id").agg(F.sum("score").alias("own"))
    return scored.join(own, "item_id").select("item_id", "first", "second", (F.col("score") / F.col("own")).alias("weight"))


def length_class(words: int) -> int:
    """The words that the items of a length class have at most: 64, 128, and so on."""
    return max(SHORTEST, 1 << max(words - 1, 0).bit_length())


class BlockMaxIndex:
    """Postings of word pairs with the largest weight of each block, and of each list."""

    def __init__(self, postings: list[tuple[int, str, str, float]], items: dict[int, str], width: int | None = None):
        self.ids = sorted({p[0] for p in postings})
        number = {d: i for i, d in enumerate(self.ids)}
        self.vocabulary: dict[str, int] = {}
        for _, a, b, _ in postings:
            self.vocabulary.setdefault(a, len(self.vocabulary))
            self.vocabulary.setdefault(b, len(self.vocabulary))
        lists: dict[int, list] = {}
        for d, a, b, w in postings:
            lists.setdefault(self.vocabulary[a] * len(self.vocabulary) + self.vocabulary[b], []).append((number[d], w))
        self.codes = np.array(sorted(lists), np.int64)
        self.lists = [sorted(lists[c]) for c in self.codes.tolist()]
        self.top = np.array([max(w for _, w in entries) for entries in self.lists] or [0.0])
        self.blocks = [[(e[min(i + BLOCK, len(e)) - 1][0], max(w for _, w in e[i : i + BLOCK])) for i in range(0, len(e), BLOCK)] for e in self.lists]
        parts = {d: question_and_answer(items[d]) for d in self.ids}
        self.parts = [tuple(_sequences(p) for p in parts[d]) for d in self.ids]
        self.width = width or max((length_class(len(q) + len(a)) for q, a in parts.values()), default=SHORTEST)

    def terms(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(places, term numbers) of the word pairs that the index has."""
        w = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero((w[:-1] >= 0) & (w[1:] >= 0))
        if not len(at) or not len(self.codes):
            return at[:0], at[:0]
        code = w[at] * len(self.vocabulary) + w[at + 1]
        term = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        found = self.codes[term] == code
        return at[found], term[found]

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All (item number, score) with a score of ``threshold`` or more, by block-max WAND."""
        cursors = [[self.lists[t][0][0], 0, t] for t in terms]  # current item, place, term
        hits = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, None
            for k, (_, _, t) in enumerate(cursors):
                bound += self.top[t]
                if bound >= threshold - 1e-9:
                    pivot = k
                    break
            if pivot is None:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            near, step = 0.0, len(self.ids)
            for _, at, t in cursors[: pivot + 1]:
                block = at // BLOCK
                while self.blocks[t][block][0] < item:
                    block += 1
                    if block == len(self.blocks[t]):
                        break
                else:
                    near += self.blocks[t][block][1]
                    step = min(step, self.blocks[t][block][0] + 1)
            if near >= threshold - 1e-9 and cursors[0][0] == item:
                score, goal = 0.0, item + 1
                for c in cursors[: pivot + 1]:
                    score += self.lists[c[2]][c[1]][1]
                if score >= threshold - 1e-9:
                    hits.append((item, score))
            elif near >= threshold - 1e-9:
                goal = item
            else:  # no item up to the end of the blocks, or to the next list, can reach the threshold
                goal = max(item + 1, min(step, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else len(self.ids)))
            alive = []
            for k, c in enumerate(cursors):
                if k <= pivot:
                    entries, at = self.lists[c[2]], c[1]
                    while at < len(entries) and entries[at][0] < goal:
                        at += 1
                    if at == len(entries):
                        continue
                    c[0], c[1] = entries[at][0], at
                alive.append(c)
            cursors = alive
        return hits

    def hits(self, text: str | None, threshold: float, overlap: float) -> dict[int, tuple[float, float, float]]:
        """(score, question's overlap, answer's overlap) of each item that a passage of the text holds."""
        words = words_of(text)
        out: dict[int, tuple] = {}
        if len(words) < 2:
            return out
        places, term = self.terms(words)
        if not len(places):
            return out
        half = self.width
        sums = np.concatenate([[0.0], np.cumsum(self.top[term])])
        starts = np.arange(0, max(1, len(words) - half), half)
        low, high = np.searchsorted(places, starts), np.searchsorted(places, starts + 2 * half - 1)
        for k in np.flatnonzero(sums[high] - sums[low] >= threshold - 1e-9).tolist():
            passage = None
            for number, score in self.search(np.unique(term[low[k] : high[k]]).tolist(), threshold):
                passage = passage or words[starts[k] : starts[k] + 2 * half]
                found = []
                for part in self.parts[number]:
                    n = len(next(iter(part))) if part else 0
                    found.append(len(part & _sequences(passage, n)) / len(part) if part else 1.0)
                if min(found) >= overlap and score > out.get(number, (0.0,))[0]:
                    out[number] = (score, *found)
        return out


def item_indexes(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[BlockMaxIndex]]:
    """For each reading of the documents, the indexes of its items, one for each length class.

    A reading's items have about ``POSTINGS_OF_PASS`` word pairs (they are dealt by a
    hash), so what is broadcast is bounded however many items there are; weights and
    counts come from all items.
    """
    src = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null and text is not null")
    src = written(src.groupBy("item_id").agg(F.min("text").alias("text")), "items")
    postings = written(item_postings(src), "postings")
    parts = -(-postings.count() // POSTINGS_OF_PASS)
    for part in range(parts):
        of = F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part
        rows: dict[int, list] = {}
        for r in postings.where(of).select("item_id", "first", "second", "weight").toLocalIterator():
            rows.setdefault(r.item_id, []).append(tuple(r))
        classes: dict[int, dict[int, str]] = {}
        for r in src.where(of).toLocalIterator():
            if r.item_id in rows:
                classes.setdefault(length_class(len(words_of(r.text))), {})[r.item_id] = r.text
        if classes:
            yield [BlockMaxIndex([p for i in texts for p in rows[i]], texts, width) for width, texts in sorted(classes.items())]


def contamination(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of each item that a document holds.

    Whole texts are searched.  Defined cases: null and empty texts hold nothing;
    an item of fewer than two words, without text or without an id is held by
    nothing; an id of several items stands for the smallest text; rows that
    repeat a document id repeat its hits; other columns are ignored.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for indexes in item_indexes(items):
        shared = spark.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for id_, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                    text = text.as_py()
                    rows += [(id_, index.ids[n], *h) for index in shared.value for n, h in index.hits(text, threshold, overlap).items()]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        got = src.mapInArrow(run, schema)
        out = got if out is None else out.union(got)
    out = spark.createDataFrame([], schema) if out is None else out
    return out.withColumnRenamed("doc_id", id_col)


def _held(shared, threshold: float, overlap: float):
    @F.arrow_udf("boolean")
    def held(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            yield pa.array([any(index.hits(text, threshold, overlap) for index in shared.value) for text in (t.as_py() for t in column)], pa.bool_())

    return held


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; only texts go to Python.

    Null and empty texts hold nothing and stay; repeated rows and null ids each count.
    """
    for indexes in item_indexes(items):
        shared = docs.sparkSession.sparkContext.broadcast(indexes)
        docs = docs.where(~_held(shared, threshold, overlap)(F.col(text_col).cast("string")))
    return docs
