"""Cost-balanced packing of documents into training sequences.

A document is tokenized and closed by an end id. Whole capacities are cut off
its front and are sequences of their own; what is left over is packed. The work
of attention within a piece of n tokens is estimated as ``linear * n +
quadratic * n * n``: pieces are taken longest first, and each goes to the
sequence of the lowest cost so far that still has room for all of it. Pieces
that fit nowhere whole are cut to fill what is open, again the cheapest first.

Each task packs its documents in groups of bounded size as they stream by, so
nothing is shuffled and no count is needed. A group gives full sequences only,
its smallest rest is carried to the next group. The last group of a task ends in
sequences whose lengths are powers of two, which need no padding either.

Null and empty texts are the end id alone, a document without an id keeps its
null, repeated rows are packed each on its own, other columns are ignored, an
empty table gives no pieces. A text of any length is cut as often as needed.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import ROWS_AT_ONCE

CAPACITY = 2048
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n. At a full sequence both halves weigh the same.
LINEAR, QUADRATIC = 1.0, 1.0 / CAPACITY
#: A group is packed when it holds that many tokens or pieces; bounds a task's memory.
GROUP_TOKENS, GROUP_PIECES = 1 << 20, 8192
#: Bytes of texts that are put together at once; bounds a task's memory, and the larger, the fewer words come twice.
TEXT_AT_ONCE = 6 << 20
#: Words whose ids a Python worker remembers, twice (two generations).
CACHED_WORDS = 250_000
#: Letters under this one are the same in every version of Unicode, and composed.
LATIN = "\u0250"
#: Longer words are encoded without being remembered.
LONG_WORD = 200

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class WordIds:
    """Token ids of texts by a tokenizers file whose tokens never cross ASCII white space.

    A batch of texts is put together by numpy from its distinct words. Words are
    encoded once and remembered. One of Latin letters is lower-cased and goes
    straight to the library's merges, as the library's own normaliser and
    splitter would send it, and a mark behind it is a word of its own; any other
    word goes through the whole library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.merges = self.library.model
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # a byte that isn't a printable character is written as one from 256 on
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        self.letters = {b: b if b in plain else next(rest) for b in range(256)}
        self.marks = {m: self._library(m) for m in ".,;:!?"}
        # a tokenizer with tokens over white space, a prefix or another way with letters would encode these otherwise
        words = "one Two, three's 4.5 \u00c9t\u00e9! (six) \u017bart x?! str\u00e6t".split(" ")
        if self._library(" \n".join(words)) != b"".join(map(self.fresh, words)):
            raise ValueError(f"{path}: this tokenizer doesn't encode word by word")

    def _library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def fresh(self, word: str) -> bytes:
        """Ids of a word; those of its letters are remembered."""
        end = self.marks.get(word[-1:], b"")
        stem = word[:-1] if end else word
        if not (stem.isalpha() and max(stem) < LATIN) or "\u0130" in stem:
            found = self._library(word)
            if len(word) <= LONG_WORD:
                self.young[word] = found
            return found
        stem = stem.lower()
        found = self.young.get(stem) or self.old.get(stem)
        if found is None:
            tokens = self.merges.tokenize(stem if stem.isascii() else stem.encode().decode("latin-1").translate(self.letters))
            found = np.array([t.id for t in tokens], "<u4").tobytes()
        if len(stem) <= LONG_WORD:
            self.young[stem] = found
        return found + end

    def of(self, words: list[str]) -> list[bytes]:
        if len(self.young) > CACHED_WORDS:
            self.old, self.young = self.young, {}
        young = self.young
        return [young.get(w) or self.fresh(w) if w else b"" for w in words]

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and the number of each text's ids."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        flat = split.flatten().dictionary_encode()
        words = self.of(flat.dictionary.to_pylist())
        if not words:
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) // 4
        starts = np.cumsum(sizes) - sizes
        pool = np.frombuffer(b"".join(words), "<u4")
        at = flat.indices.to_numpy(zero_copy_only=False)
        n = sizes[at]
        ends = np.cumsum(n)
        ids = pool[np.repeat(starts[at] - (ends - n), n) + np.arange(ends[-1])]
        bounds = np.r_[0, ends][split.offsets.to_numpy()]
        return ids, np.diff(bounds)


def powers(n: int) -> list[int]:
    """The powers of two that add up to n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def assign(lengths: np.ndarray, capacities: list[int], linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int]]]:
    """Deal pieces to sequences: (piece, from, length, sequence, offset) of each part, and (piece, from) of what isn't placed.

    Longest first to the cheapest sequence with room for the whole piece; then
    those that had none are cut to fill the cheapest open sequences. Of equal
    costs the first sequence is taken, of equal lengths the first piece.
    """
    left = np.array(capacities, np.int64)
    cost = np.zeros(len(left))
    used = np.zeros(len(left), np.int64)
    parts, waiting, rest = [], [], []

    def put(piece: int, start: int, n: int, s: int) -> None:
        parts.append((piece, start, n, s, int(used[s])))
        used[s] += n
        left[s] -= n
        cost[s] += linear * n + quadratic * n * n

    for piece in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[piece])
        open_cost = np.where(left >= n, cost, np.inf)
        s = int(open_cost.argmin()) if len(left) else 0
        if len(left) and open_cost[s] < np.inf:
            put(piece, 0, n, s)
        else:
            waiting.append(piece)
    for piece in waiting:
        n, start = int(lengths[piece]), 0
        while start < n:
            open_cost = np.where(left > 0, cost, np.inf)
            s = int(open_cost.argmin()) if len(left) else 0
            if not len(left) or open_cost[s] == np.inf:
                rest.append((piece, start))
                break
            take = min(n - start, int(left[s]))
            put(piece, start, take, s)
            start += take
    return parts, rest


class Packer:
    """Packs the pieces of one task, group by group; ``full`` gives rows of PIECES."""

    def __init__(self, first_sequence: int, capacity: int, linear: float, quadratic: float):
        self.capacity, self.linear, self.quadratic = capacity, linear, quadratic
        self.next = first_sequence
        self.pieces: list[tuple] = []  # (doc_id, start in the document, ids, tokens of the document)
        self.tokens = 0
        self.out: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        whole = len(ids) // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            self.out.append((doc_id, start, self.capacity, ids[start : start + self.capacity].tobytes(), len(ids), self.next, 0))
            self.next += 1
        if whole < len(ids):
            self.pieces.append((doc_id, whole, ids[whole:].copy(), len(ids)))
            self.tokens += len(ids) - whole
        if self.tokens >= GROUP_TOKENS or len(self.pieces) >= GROUP_PIECES:
            self.pack(last=False)

    def pack(self, last: bool) -> None:
        capacities = [self.capacity] * (self.tokens // self.capacity)
        if last:
            capacities += powers(self.tokens % self.capacity)
        pieces = self.pieces
        parts, rest = assign(np.array([len(p[2]) for p in pieces], np.int64), capacities, self.linear, self.quadratic)
        for i, start, n, s, offset in parts:
            doc_id, at, ids, total = pieces[i]
            self.out.append((doc_id, at + start, n, ids[start : start + n].tobytes(), total, self.next + s, offset))
        self.next += len(capacities)
        self.pieces = [(pieces[i][0], pieces[i][1] + start, pieces[i][2][start:], pieces[i][3]) for i, start in rest]
        self.tokens = sum(len(p[2]) for p in self.pieces)

    def full(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def _portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows from and to of portions of a batch with about TEXT_AT_ONCE bytes; a longer text is one alone."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(upto):
        before = int(upto[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + TEXT_AT_ONCE, "right")))
        yield at, end
        at = end


_ready: dict[str, WordIds] = {}


def pack(
    docs: DataFrame,
    path: str,
    capacity: int = CAPACITY,
    end_id: int = 1,
    linear: float = LINEAR,
    quadratic: float = QUADRATIC,
) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) of each piece of each document.

    ``ids`` are little-endian unsigned 32-bit token ids by the tokenizer file at
    ``path`` without special tokens, then ``end_id``; ``start`` counts the
    document's ids before the piece, ``offset`` those before it in its sequence.
    A sequence number holds the number of the task, so it is unique.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    types = T._parse_datatype_string(PIECES)
    types["doc_id"].dataType = docs.schema["doc_id"].dataType
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ready:
            _ready.clear()
            _ready[path] = WordIds(path)
        words = _ready[path]
        packer = Packer(TaskContext.get().partitionId() << 40, capacity, linear, quadratic)
        kinds = None

        def rows() -> Iterator[pa.RecordBatch]:
            found = packer.full()
            for at in range(0, len(found), 4 * ROWS_AT_ONCE):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found[at : at + 4 * ROWS_AT_ONCE], strict=True), kinds, strict=True)], names=types.fieldNames())

        for whole in batches:
            kinds = [whole.schema.field(0).type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            for at, end in _portions(whole.column(1)):
                batch = whole.slice(at, end - at)
                ids, sizes = words.batch([t or "" for t in batch.column(1).to_pylist()])
                ends = np.cumsum(sizes)
                for doc_id, start, end in zip(batch.column(0).to_pylist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
                    packer.add(doc_id, np.append(ids[start:end], np.uint32(end_id)).astype("<u4"))
                yield from rows()
        packer.pack(last=True)
        yield from rows()

    return source.mapInArrow(run, types)


def piece_cost(length, linear: float = LINEAR, quadratic: float = QUADRATIC):
    """Estimated work of a piece, as a column."""
    return linear * length + quadratic * length * length


def sequences(pieces: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, lengths, n_tokens, cost): the packed sequences as little-endian 32-bit ids.

    ``lengths`` are those of the pieces in order, for an attention mask that
    keeps them apart. Sequences are padded to ``capacity``, but those whose
    length is a power of two. A group has at most ``capacity`` pieces.
    """
    part = F.struct("offset", "length", "ids")
    whole = pieces.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(part)).alias("parts"), F.sum("length").alias("n_tokens"), F.sum(piece_cost(F.col("length"))).alias("cost")
    )
    ids = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    alone = F.expr("n_tokens & (n_tokens - 1)") == 0
    padding = F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), F.when(alone, 0).otherwise(capacity - F.col("n_tokens")).cast("int"))
    return whole.select("sequence_id", F.concat(ids, F.unhex(padding)).alias("ids"), F.col("parts.length").alias("lengths"), "n_tokens", "cost")
