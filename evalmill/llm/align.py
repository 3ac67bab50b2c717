"""Two tokenizers' cuts of the same texts, laid over each other.

A task takes its Arrow batch in slices: all texts of a slice are one string of
bytes, with an offset for each document.  The ends of both tokenizers' tokens
are counted by byte once for the slice; where both have one, a group ends, and
between any two neighbouring ends lies one link of an A token and a B token.
Prefix sums taken at the documents' offsets give back what belongs to whom.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .wordpiece import _byte_letters

#: Bytes of text laid over each other at once; one longer text is a slice of its own.
SLICE_BYTES = 2 << 20
#: Most pairs whose counts are sent to all tasks (24 bytes each); the links of all other pairs are joined by a shuffle.
HEAD_PAIRS = 1 << 18
_CHUNKS = 1 << 18
_SPACE = "▁"
#: What tiktoken's splitting has to be for the byte-level pre-tokenizer: the pattern of that pre-tokenizer (fixed value).
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteLevel:
    """Ids of a byte-level BPE file and the bytes of each id.

    Where the file's merges are its ids in order, and it has the plain byte-level
    splitting without normalizer, tiktoken takes over its vocabulary; any other
    file is left to its own library.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        special = {t["content"] for t in spec.get("added_tokens") or ()}
        self.bytes = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens") or ())]))
        for piece, i in vocab.items():
            self.bytes[i] = piece.encode() if piece in special else bytes(letters[c] for c in piece)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and not spec["model"].get("dropout") and not spec["model"].get("ignore_merges")
        plain = plain and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)) and len(vocab) - len(special & vocab.keys()) == 256 + len(merges)
        if plain:
            ranks = {self.bytes[i]: i for p, i in vocab.items() if p not in special}
            self._encode = tiktoken.Encoding("byte_level", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            tokenizer = tokenizers.Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            self._encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        return [self._encode(t) for t in texts]


class Pieces:
    """Ids of a SentencePiece file, which sets a space before each text, and the bytes of each id.

    Where no piece goes on after a space that follows another character, words
    with the spaces before them are encoded each for itself, and kept.
    """

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.by_word = _SPACE in pieces and not any(_SPACE in p.lstrip(_SPACE) for p in pieces)
        self.lone = [self.model.piece_to_id(_SPACE)]  # a space that ends a text; the model sets none before an empty text
        self.known: dict[str, list[int]] = {"": self.lone}

    def _words(self, text: str) -> list[str]:
        words = text.split(" ")
        if "" not in words:
            return words
        out, spaces = [], 0
        for w in words[:-1]:
            if w:
                out.append(" " * spaces + w)
                spaces = 0
            else:
                spaces += 1
        return [*out, " " * spaces + words[-1]]

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        if not self.by_word:
            return self.model.encode(list(texts), num_threads=1)
        dealt, known = [self._words(t) for t in texts], self.known
        if len(known) > _CHUNKS:
            known.clear()
            known[""] = self.lone
        new = list(set(chain.from_iterable(dealt)) - known.keys())
        known.update(zip(new, self.model.encode(new, num_threads=1)))
        return [list(chain.from_iterable(map(known.__getitem__, words))) for words in dealt]


def _written_ids(size: int, marks: str) -> np.ndarray:
    """The decimal text of each id with each of the marks behind it, in fixed width."""
    return np.array([f"{i}{m}".encode() for m in marks for i in range(size)])


class Aligner:
    """Alignments of slices of texts; one for each Python worker."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.a_size, self.b_size = np.array([len(x) for x in self.a.bytes]), np.array([len(x) for x in self.b.bytes])
        self.a_text, self.b_text = _written_ids(len(self.a_size), ",|"), _written_ids(len(self.b_size), ",;")
        width = max(self.a_text.dtype.itemsize, self.b_text.dtype.itemsize)
        self.texts = np.concatenate([self.a_text, self.b_text]).astype(f"S{width}")

    def align(self, texts: Sequence[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Of each text: (n_a, n_b, n_groups, n_links) and its groups as text; and (text, a, b), times of all different linked ids."""
        spaced = [" " + t for t in texts]
        a_ids, b_ids = self.a.encode(spaced), self.b.encode(texts)
        raw = [s.encode() for s in spaced]
        sound = [bool(t) and b"".join(map(self.a.bytes.__getitem__, x)) == r and b"".join(map(self.b.bytes.__getitem__, y)) == r for t, r, x, y in zip(texts, raw, a_ids, b_ids)]
        n_a = np.array([len(x) if ok else 0 for x, ok in zip(a_ids, sound)], np.int64)
        n_b = np.array([len(y) if ok else 0 for y, ok in zip(b_ids, sound)], np.int64)
        offsets = np.cumsum([0, *(len(r) if ok else 0 for r, ok in zip(raw, sound))])
        a = np.fromiter(chain.from_iterable(x for x, ok in zip(a_ids, sound) if ok), np.int64, n_a.sum())
        b = np.fromiter(chain.from_iterable(y for y, ok in zip(b_ids, sound) if ok), np.int64, n_b.sum())
        size = int(offsets[-1])
        a_ends, b_ends = (np.bincount(np.cumsum(step[ids]), minlength=size + 1)[1:].astype(np.int8) for step, ids in ((self.a_size, a), (self.b_size, b)))
        both = (a_ends & b_ends).astype(np.int8)
        ends = np.flatnonzero(a_ends | b_ends)

        def before(x: np.ndarray) -> np.ndarray:
            """How many of ``x`` lie before each byte, and before the end."""
            return np.concatenate([[0], np.cumsum(x, dtype=np.int64)])

        a_sum, b_sum, cuts = before(a_ends), before(b_ends), before(both)
        links = np.searchsorted(ends, offsets)
        counts = np.stack([n_a, n_b, np.diff(cuts[offsets]), np.diff(links)], axis=1)

        owner = np.repeat(np.arange(len(texts)), counts[:, 3])
        low, high = len(self.b_size), len(self.a_size)
        keys = (owner * high + a[a_sum[ends]]) * low + b[b_sum[ends]]
        keys, times = np.unique(keys, return_counts=True)
        pairs = np.stack([keys // (low * high), keys // low % high, keys % low])

        a_at, b_at = np.flatnonzero(a_ends), np.flatnonzero(b_ends)
        a_group, b_group = cuts[a_at], cuts[b_at]
        cut_at = np.flatnonzero(both)
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + (b_sum[np.concatenate([[0], cut_at + 1])][a_group] if len(a) else 0)] = a + high * both[a_at].astype(np.int64)
        out[np.arange(len(b)) + (a_sum[cut_at + 1][b_group] if len(b) else 0)] = 2 * high + b + low * both[b_at].astype(np.int64)
        ids_to = np.cumsum([0, *(n_a + n_b)])
        said = [self.texts[out[s:e]].tobytes().translate(None, b"\0")[:-1].decode() for s, e in zip(ids_to, ids_to[1:])]
        return counts, said, pairs, times


_aligners: dict[tuple[str, str], Aligner] = {}

_PAIR = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32())])
_OUT = pa.schema([("id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()), ("pairs", pa.list_(_PAIR))])


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Neighbouring rows of SLICE_BYTES in all, at least one."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > SLICE_BYTES:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def _aligned(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (a_path, b_path)
        if key not in _aligners:
            _aligners[key] = Aligner(a_path, b_path)
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
            for start, end in _slices(sizes):
                rows = batch.slice(start, end - start)
                counts, groups, pairs, times = _aligners[key].align([t or "" for t in rows.column(1).to_pylist()])
                entries = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (pairs[1], pairs[2], times)], fields=list(_PAIR))
                starts = np.searchsorted(pairs[0], np.arange(rows.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c) for c in counts.T), pa.array(groups, pa.string()), pa.ListArray.from_arrays(pa.array(starts), entries)], schema=_OUT)

    return run


def alignments(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's tokens by two tokenizers, cut into groups wherever both end a token.

    ``a_path`` is a byte-level BPE file and encodes a space and the text,
    ``b_path`` a SentencePiece file, which adds the space itself.  Gives the id,
    n_a, n_b, n_groups, n_links, ``groups`` (``a1,a2|b1;a3|b2``) and ``pairs``
    (a, b, n): how often an A and a B token overlap by at least one byte.
    Defined cases: a text that is null or empty, or that one of the tokenizers
    does not give back byte by byte, has no tokens; strings of special tokens
    are plain text; repeated and null ids each keep their row; other columns are
    ignored.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    kinds = "id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<struct<a: int, b: int, n: int>>"
    return src.mapInArrow(_aligned(a_path, b_path), kinds).withColumnRenamed("id", id_col)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, docs, best): in how many rows of (a, b) a pair stands, and whether no pair of its ``a`` stands in more."""
    counts = written(pairs.groupBy("a", "b").agg(F.count("*").alias("docs")), "pair_counts")
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))  # one row an id: no more than the vocabulary has
    return counts.join(F.broadcast(most), "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("best"))


def linked(aligned: DataFrame) -> DataFrame:
    """Adds n_best and count_sum to rows of :func:`alignments`, and drops ``pairs``.

    The rows are written once, so that nothing is encoded twice.  Counts of
    pairs that stand in very many documents are sent to all tasks (as many as
    HEAD_PAIRS allows, by a histogram of the counts); links of the others are
    joined by a shuffle.  All links get their count, whichever way.
    """
    rows = written(aligned.withColumn("row", F.monotonically_increasing_id()), "alignments")
    pairs = rows.select("row", F.explode("pairs").alias("pair")).select("row", "pair.*")
    counts = written(pair_counts(pairs.select("a", "b")), "pair_best")
    size = F.floor(F.log2("docs")).cast("int")
    held, least = 0, 64
    for r in sorted(counts.groupBy(size.alias("e")).count().collect(), reverse=True):  # at most 64 rows
        held += r["count"]
        if held > HEAD_PAIRS:
            break
        least = r["e"]
    head = F.broadcast(counts.where(size >= least))
    found = pairs.join(head, ["a", "b"], "left")
    rest = found.where("docs is null").select("row", "a", "b", "n").join(counts.where(size < least), ["a", "b"])

    def summed(links: DataFrame) -> DataFrame:
        return links.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum"))

    sums = summed(found.where("docs is not null")).union(summed(rest)).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.drop("pairs").join(sums, "row", "left").drop("row").fillna(0, ["n_best", "count_sum"])
