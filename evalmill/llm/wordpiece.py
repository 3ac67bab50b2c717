"""Token counts by greedy longest match, in time linear in the text.

The vocabulary becomes a trie with failure links: where no longer piece follows,
the link leads to the node of what is left after the popped pieces, and the
number of popped pieces is precomputed.  A word is so scanned once, character by
character, and its greedy pieces are counted without ever being built.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+|[^\w\s]")
_CACHE = 1 << 20


class LongestMatch:
    """Counts of greedy longest-match pieces of a word.

    ``pieces`` are plain strings; a piece that begins with ``prefix`` may stand
    only inside a word, all others only at its start (with an empty prefix any
    piece may stand anywhere).  ``end`` is appended to each word first.
    """

    def __init__(self, pieces: Iterable[str], prefix: str = "", end: str = ""):
        self.prefix, self.end = prefix, end
        self.next: list[dict[str, int]] = [{}]
        self.whole: list[bool] = [False]
        self.root = 0
        self.inner = self._path("", 0) if not prefix else self._fresh()
        for piece in pieces:
            if prefix and piece.startswith(prefix) and len(piece) > len(prefix):
                self.whole[self._path(piece[len(prefix) :], self.inner)] = True
            elif piece and not (prefix and piece.startswith(prefix)):
                self.whole[self._path(piece, self.root)] = True
        self._link()

    def _fresh(self) -> int:
        self.next.append({})
        self.whole.append(False)
        return len(self.next) - 1

    def _path(self, text: str, node: int) -> int:
        for ch in text:
            step = self.next[node].get(ch)
            if step is None:
                step = self.next[node][ch] = self._fresh()
            node = step
        return node

    def _link(self) -> None:
        """Failure links and popped counts, breadth first; -1 where nothing can be popped."""
        n = len(self.next)
        self.fail, self.popped = [-1] * n, [0] * n
        queue = deque((r, ch, v) for r in {self.root, self.inner} for ch, v in self.next[r].items())
        while queue:
            u, ch, v = queue.popleft()
            if self.whole[v]:
                self.fail[v], self.popped[v] = self.inner, 1
            else:
                z, count = self.fail[u], self.popped[u]
                while z != -1 and ch not in self.next[z]:
                    count += self.popped[z]
                    z = self.fail[z]
                if z != -1:
                    self.fail[v], self.popped[v] = self.next[z][ch], count
            queue.extend((v, c, w) for c, w in self.next[v].items())

    def count(self, word: str) -> int:
        """Number of pieces; 0 if the greedy match meets a place where no piece fits."""
        node, count = self.root, 0
        for ch in word + self.end:
            while (step := self.next[node].get(ch)) is None:
                if self.fail[node] == -1:
                    return 0
                count += self.popped[node]
                node = self.fail[node]
            node = step
        while node != self.inner:
            if self.fail[node] == -1:
                return 0
            count += self.popped[node]
            node = self.fail[node]
        return count


class _Counts(dict):
    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE:
            self.clear()
        n = self[word] = self.automaton.count(word)
        return n


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_vocabulary(path: str) -> list[str]:
    """The pieces of a vocabulary file: a ``tokenizer.json``, or one piece a line.

    Pieces of a byte-level vocabulary are turned back into text; those that end
    inside a character are left out.
    """
    with open(path, encoding="utf-8") as f:
        if not path.endswith(".json"):
            return [line.rstrip("\n") for line in f]
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    pieces = list(vocab) if isinstance(vocab, dict) else [p for p, _ in vocab]
    if '"ByteLevel"' not in json.dumps(spec.get("pre_tokenizer")):
        return pieces
    letters, out = _byte_letters(), []
    for piece in pieces:
        try:
            out.append(bytes(letters[c] for c in piece).decode())
        except (KeyError, UnicodeDecodeError):
            continue
    return out


_tables: dict[tuple, _Counts] = {}


def _counts(path: str, prefix: str, end: str) -> _Counts:
    """One automaton for each Python worker, built from the vocabulary file on its machine."""
    key = (path, prefix, end)
    if key not in _tables:
        _tables[key] = _Counts(LongestMatch(read_vocabulary(path), prefix, end))
    return _tables[key]


def _counter(path: str, prefix: str, end: str):
    out = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counts(path, prefix, end)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [])
            for text in batch.column(1):
                words = _WORD.findall((text.as_py() or "").lower())
                got = list(map(counts.__getitem__, words))
                unknown = got.count(0)
                for to, n in zip(rows, (len(words), sum(got) + unknown, unknown)):
                    to.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(r, pa.int64()) for r in rows)], schema=out)

    return run


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", prefix: str = "##", end: str = "") -> DataFrame:
    """(id, n_words, n_tokens, n_unknown) of each row, over whole texts.

    Texts are lower-cased; words are runs of word characters and single other
    characters, white space apart.  A word that greedy longest match can't
    divide is one unknown token.  Defined cases: null and empty texts have 0 of
    each; repeated and null ids each keep their row; other columns are ignored.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = src.mapInArrow(_counter(vocabulary, prefix, end), "id long, n_words long, n_tokens long, n_unknown long")
    return out.withColumnRenamed("id", id_col)
