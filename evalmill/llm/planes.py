"""Token ids in a binary format of shuffled bit or byte planes.

A file holds the ids of a range of documents in ascending order of their id.
Ids go in blocks of fixed size; a block's unsigned 32-bit values are transposed
into 4 byte planes (or 32 bit planes), and each plane is compressed by itself,
since high planes are almost constant.  The last record is the block index.

Record::

    magic "EMP1" | kind u8 | body length u32 | body | "\\n"

Block body (kind 1)::

    ids u32 | documents u32 | planes u8 | bit planes? u8 | plane sizes u32[planes]
    | document ids i64[documents] | token counts u64[documents] | planes

A block lists the documents that begin in it.  Index body (kind 2), all u64::

    blocks | (offset, ids before, documents before)[blocks] | offset of this record

All numbers are little-endian.  The closing line feed belongs to each record.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import new_path, written

MAGIC, BLOCK, INDEX = b"EMP1", 1, 2
BLOCK_IDS = 1 << 16
FILE_BYTES = 16 << 20  # text to a file, about
CACHED_WORDS = 400_000
END_ID = 2
FILES_OF_GROUP = 1024  # files whose sums one task adds up


def _record(kind: int, body: bytes) -> bytes:
    return MAGIC + struct.pack("<BI", kind, len(body)) + body


def split_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The byte (or bit) planes of unsigned 32-bit ids, lowest first."""
    table = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(table[:, i]).tobytes() for i in range(4)]
    flags = np.unpackbits(table, axis=1, bitorder="little")
    return [np.packbits(flags[:, i], bitorder="little").tobytes() for i in range(32)]


def join_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    """The ids that ``split_planes`` took apart."""
    if not bits:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).view("<u4").reshape(-1) if n else np.empty(0, "<u4")
    flags = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(flags, axis=1, bitorder="little").view("<u4").reshape(-1)


class PlaneWriter:
    """Takes documents in order and gives the records of one file."""

    def __init__(self, block_ids: int = BLOCK_IDS, bits: bool = False, level: int = 3):
        self.block_ids, self.bits, self.zstd = block_ids, bits, zstandard.ZstdCompressor(level=level)
        self.parts: list[np.ndarray] = []
        self.held = 0
        self.begun: list[tuple[int, int, int]] = []  # start in the held ids, document id, tokens
        self.index: list[tuple[int, int, int]] = []
        self.offset = self.ids = self.docs = 0

    def add(self, doc_id: int, ids: np.ndarray) -> Iterator[bytes]:
        self.begun.append((self.held, doc_id, len(ids)))
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.block_ids:
            yield from self._blocks(last=False)

    def _blocks(self, last: bool) -> Iterator[bytes]:
        ids = np.concatenate(self.parts) if self.parts else np.empty(0, "<u4")
        at = 0
        while len(ids) - at >= self.block_ids or (last and (at < len(ids) or self.begun)):
            block = ids[at : at + self.block_ids]
            end = at + self.block_ids
            here = [d for d in self.begun if d[0] < end or (last and end >= len(ids))]
            self.begun = self.begun[len(here) :]
            yield self._block(block, here)
            at += len(block)
        self.parts, self.held = [ids[at:]], len(ids) - at
        self.begun = [(start - at, d, n) for start, d, n in self.begun]

    def _block(self, block: np.ndarray, docs: list[tuple[int, int, int]]) -> bytes:
        planes = [self.zstd.compress(p) for p in split_planes(block, self.bits)]
        body = struct.pack("<IIBB", len(block), len(docs), len(planes), self.bits) + np.array([len(p) for p in planes], "<u4").tobytes()
        body += np.array([d[1] for d in docs], "<i8").tobytes() + np.array([d[2] for d in docs], "<u8").tobytes() + b"".join(planes)
        record = _record(BLOCK, body)
        self.index.append((self.offset, self.ids, self.docs))
        self.offset += len(record) + 1
        self.ids += len(block)
        self.docs += len(docs)
        return record

    def close(self) -> Iterator[bytes]:
        yield from self._blocks(last=True)
        body = struct.pack("<Q", len(self.index)) + np.array(self.index, "<u8").reshape(-1, 3).tobytes() + struct.pack("<Q", self.offset)
        yield _record(INDEX, body)


def read_blocks(content: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, document ids, their token counts) of each block, found by the index."""
    if not content:
        return
    (at,) = struct.unpack_from("<Q", content, len(content) - 9)
    if content[at : at + 4] != MAGIC or content[at + 4] != INDEX:
        raise ValueError("no block index at the end of the file")
    (blocks,) = struct.unpack_from("<Q", content, at + 9)
    index = np.frombuffer(content, "<u8", 3 * blocks, at + 17).reshape(-1, 3)
    unzip = zstandard.ZstdDecompressor()
    for offset in index[:, 0].tolist():
        at = offset + 9
        n, docs, count, bits = struct.unpack_from("<IIBB", content, at)
        at += 10
        sizes = np.frombuffer(content, "<u4", count, at)
        at += 4 * count
        doc_ids = np.frombuffer(content, "<i8", docs, at)
        tokens = np.frombuffer(content, "<u8", docs, at + 8 * docs)
        at += 16 * docs
        planes = []
        for size in sizes.tolist():
            planes.append(unzip.decompress(content[at : at + size]))
            at += size
        yield join_planes(planes, n, bool(bits)), doc_ids, tokens


class WordEncoder:
    """Encodes texts with the tokenizers library, each distinct word once while it is kept.

    The tokenizer's pattern never joins characters over white space, nor a
    letter with the punctuation after it, so a text's ids are those of its
    pieces one after the other.  A run of Latin letters is one piece, which its
    lower-case form gives to the library's model directly; any other word goes
    through the whole tokenizer as it stands, since special tokens match the
    text as written.
    """

    TAIL = b".,!?;:%$#&*|"
    #: Characters of the bytes of a text in the vocabulary, by the public byte-level rule: printable bytes stand for themselves.
    BYTES = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}

    def __init__(self, path: str, limit: int = CACHED_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.model = self.tokenizer.model
        self.pieces: dict[bytes, bytes] = {}
        self.clear()

    def clear(self) -> None:
        """Forgets the words; their pieces, which are fewer, stay until there are as many."""
        outer = self
        if len(self.pieces) > self.limit:
            self.pieces = {}

        class Places(dict):
            def __missing__(self, word: bytes) -> int:
                place = self[word] = len(self)
                outer.fresh.append(word)
                return place

        self.places, self.fresh = Places(), []
        self.flat = np.empty(0, "<u4")
        self.starts, self.sizes = np.empty(0, np.int64), np.empty(0, np.int64)

    def _whole(self, words: list[bytes]) -> list[bytes]:
        """The ids of words, as bytes, by the whole tokenizer."""
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def _piece(self, word: bytes) -> bytes | None:
        """The ids of a run of Latin letters; None for anything else.  Letters below U+0250 have one composed form."""
        if word.isalpha():  # ASCII letters alone, in lower case already
            shown = word.decode()
        else:
            text = word.decode().lower()
            if not text.isalpha() or max(text) >= "ɐ":
                return None
            shown = text.encode().decode("latin-1").translate(self.BYTES)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _learn(self) -> None:
        """Adds the ids of the words met since the last call."""
        rows: list[bytes] = []
        odd: list[int] = []
        pieces = self.pieces
        for word in self.fresh:
            body = word.rstrip(self.TAIL)
            key = body.lower()
            ids = pieces.get(key)
            if ids is None and body:
                ids = self._piece(key)
                if ids is not None:
                    pieces[key] = ids
            if ids is not None and len(body) < len(word):
                tail = word[len(body) :]
                if (end := pieces.get(tail)) is None:
                    end = pieces[tail] = self._whole([tail])[0]
                ids += end
            if ids is None:
                odd.append(len(rows))
            rows.append(ids)
        for at, ids in zip(odd, self._whole([self.fresh[i] for i in odd])):
            rows[at] = ids
        sizes = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(rows), "<u4")])
        self.fresh = []

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """The ids of each text; none for a null or empty one."""
        if len(self.places) > self.limit:
            self.clear()
        split = pc.ascii_split_whitespace(pa.array([t or "" for t in texts], pa.large_string()))
        words = split.flatten()
        there = pc.greater(pc.binary_length(words), 0)
        upto = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])  # words before each piece between white space
        upto = upto[split.offsets.to_numpy() - split.offsets[0].as_py()]
        coded = words.filter(there).dictionary_encode()
        distinct = coded.dictionary.cast(pa.large_binary()).to_pylist()
        places = np.fromiter(map(self.places.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        if self.fresh:
            self._learn()
        sizes = self.sizes[places]
        ends = np.cumsum(sizes)
        ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[places] - (ends - sizes), sizes)]
        return np.split(ids, np.concatenate([[0], ends])[upto[1:-1]]) if len(split) else []


class TextEncoder:
    """Encodes whole texts with the tokenizers library, whatever its file says."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


#: What a tokenizer file has to say for its texts to be encoded word by word (fixed values).
WORD_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}
_MODEL_RULES = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "ignore_merges": False}


def encodes_by_word(path: str) -> bool:
    """Whether a tokenizer file has the rules that :class:`WordEncoder` relies on."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = [t for t in spec.get("added_tokens") or () if t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized") or any(c.isspace() for c in t["content"])]
    return not added and all(spec.get(k) == v for k, v in WORD_RULES.items()) and all(spec["model"].get(k, v) == v for k, v in _MODEL_RULES.items())


_encoders: dict[str, WordEncoder | TextEncoder] = {}


def _encoder(path: str) -> WordEncoder | TextEncoder:
    """One encoder for each Python worker, which Spark reuses for later tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path) if encodes_by_word(path) else TextEncoder(path)
    return _encoders[path]


def _slices(batch: pa.RecordBatch, chars: int = 4 << 20) -> Iterator[tuple[list, list]]:
    ids, texts, held = [], [], 0
    for id_, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        t = text.as_py()
        ids.append(id_)
        texts.append(t)
        held += len(t or "")
        if held >= chars:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _file_maker(tokenizer: str, end_id: int, block_ids: int, bits: bool):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out = _encoder(tokenizer), PlaneWriter(block_ids, bits)
        end, seen = np.array([end_id], "<u4"), False
        give = lambda records: pa.RecordBatch.from_pydict({"record": pa.array(records, pa.binary())})
        for batch in batches:
            for doc_ids, texts in _slices(batch):
                seen = True
                records = [r for d, ids in zip(doc_ids, encoder.encode(texts)) for r in out.add(d, np.concatenate([ids, end]))]
                if records:
                    yield give(records)
        if seen:
            yield give(list(out.close()))

    return make


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    block_ids: int = BLOCK_IDS,
    bits: bool = False,
    file_bytes: int = FILE_BYTES,
) -> str:
    """Writes the ids of all texts in ascending order of their ids; gives the folder.

    File numbers rise as the documents do.  ``tokenizer`` is any tokenizer.json;
    one with the rules of words in lower case is encoded word by word, any other
    by whole texts.  Defined cases: a null or empty text is
    the end id alone; rows that repeat an id stand one after the other, by text;
    rows without an id come first and carry the smallest 64-bit id; other
    columns are ignored; an empty table gives files without records.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long")).alias("id"), F.col(text_col).cast("string").alias("text"))
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-size // file_bytes))
    dealt = src.repartitionByRange(files, "id").sortWithinPartitions("id", "text")
    records = dealt.mapInArrow(_file_maker(tokenizer, end_id, block_ids, bits), "record binary")
    records.select(F.col("record").cast("string")).write.text(path)
    return path


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file", pa.string()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for name, content in zip(batch.column("file").to_pylist(), batch.column("content")):
            rows: dict[str, list] = {k: [] for k in schema.names}
            start = left = crc = 0
            waiting: list[tuple[int, int]] = []
            for ids, doc_ids, tokens in read_blocks(content.as_py()):
                waiting += zip(doc_ids.tolist(), tokens.tolist())
                at = 0
                while waiting:
                    doc_id, n = waiting[0]
                    take = min(n - left, len(ids) - at)
                    crc = zlib.crc32(np.ascontiguousarray(ids[at : at + take], "<u4").tobytes(), crc)
                    at, left = at + take, left + take
                    if left < n:
                        break
                    for k, v in zip(schema.names, (name, doc_id, start, n, crc)):
                        rows[k].append(v)
                    start, left, crc = start + n, 0, 0
                    waiting.pop(0)
            if waiting:
                raise ValueError(f"{name} ends inside document {waiting[0][0]}")
            yield pa.RecordBatch.from_pydict(rows, schema=schema)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    files = files.where("length > 0").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    docs = written(files.mapInArrow(_summaries, "file string, doc_id long, start long, n_tokens long, ids_crc32 long"), "read_back")
    totals = docs.groupBy("file").agg(F.sum("n_tokens").alias("tokens"))
    # files are numbered as documents are sorted; their sums go up in two steps, so that no task sees all files
    number = F.regexp_extract("file", r"^part-(\d+)", 1).cast("long")
    totals = written(totals.select("file", "tokens", number.alias("_number"), F.floor(number / FILES_OF_GROUP).alias("_group")), "totals")
    groups = totals.groupBy("_group").agg(F.sum("tokens").alias("_tokens"))
    groups = groups.select("_group", (F.sum("_tokens").over(Window.orderBy("_group")) - F.col("_tokens")).alias("_base"))
    inside = F.sum("tokens").over(Window.partitionBy("_group").orderBy("_number")) - F.col("tokens")
    before = totals.join(groups, "_group").select("file", (F.col("_base") + inside).alias("before"))
    return docs.join(before, "file").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
