"""Byte-level BPE: encoding and decoding by a file of token ranks.

A text is cut by the vocabulary's pattern; within a match, a segment tree over
byte positions holds at each node the leftmost minimum rank of the adjacent
pairs below it. A merge reads the root and then updates three leaves: the merged
pair, its live left neighbour and the position that has died. Short matches are
merged many at a time, with one tree a column of an array; long ones alone.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import append_from_text, share

#: Matches whose ids a Python worker remembers, besides those of the texts at hand and as many older ones.
CACHED_MATCHES = 120_000
#: Characters of texts whose matches are merged together; a longer text is on its own.
CHARS_AT_ONCE = 1 << 20
#: Leaves of the trees that are merged together, by the size of match they are for; longer matches are merged alone.
_WIDTHS = (8, 16, 32, 64)
#: Leaves of all trees of one array.
_LEAVES_AT_ONCE = 1 << 17
#: Leaves hold rank << _SHIFT | position, so the smallest key is the leftmost of the lowest rank.
_SHIFT = 40
_NONE = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PairRanks:
    """Minimum segment tree over byte positions."""

    def __init__(self, keys: list[int]):
        self.size = 1 << max(0, len(keys) - 1).bit_length()
        self.nodes = nodes = [_NONE] * self.size + keys + [_NONE] * (self.size - len(keys))
        for i in range(self.size - 1, 0, -1):
            left, right = nodes[2 * i], nodes[2 * i + 1]
            nodes[i] = left if left < right else right

    def least(self) -> int:
        return self.nodes[1]

    def update(self, at: int, key: int) -> None:
        nodes = self.nodes
        at += self.size
        nodes[at] = key
        while at > 1:
            other = nodes[at ^ 1]
            at >>= 1
            if other < key:
                key = other
            if nodes[at] == key:
                return
            nodes[at] = key


class PairRankTrees:
    """Minimum segment trees of one size, a column each; an update changes one leaf of each of the columns named."""

    def __init__(self, keys: np.ndarray):
        self.size = len(keys)
        self.nodes = np.empty((2 * self.size, keys.shape[1]), np.int64)
        self.nodes[self.size :] = keys
        half = self.size // 2
        while half:
            below = self.nodes[2 * half : 4 * half]
            np.minimum(below[::2], below[1::2], out=self.nodes[half : 2 * half])
            half //= 2

    def least(self, columns: np.ndarray) -> np.ndarray:
        return self.nodes[1, columns]

    def update(self, at: np.ndarray, columns: np.ndarray, keys: np.ndarray) -> None:
        nodes, at = self.nodes, at + self.size
        nodes[at, columns] = keys
        for _ in range(self.size.bit_length() - 1):
            keys = np.minimum(keys, nodes[at ^ 1, columns])
            at = at >> 1
            changed = np.flatnonzero(nodes[at, columns] != keys)
            if not len(changed):
                return
            if 2 * len(changed) < len(keys):
                at, columns, keys = at[changed], columns[changed], keys[changed]
            nodes[at, columns] = keys


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.remembered: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # (left id, right id) of every cut of every token into two tokens, and the token's rank
        cuts = {
            left << 32 | right: rank
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None
        }
        self.pairs = np.array(sorted(cuts), np.int64)
        self.pair_ranks = np.array([cuts[k] for k in self.pairs.tolist()], np.int64)

    def pair_keys(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Keys of the pairs at places ``at``; a negative id stands for no token and makes no pair."""
        if not len(self.pairs):
            return np.full(np.shape(left), _NONE)
        wanted = left << 32 | right
        found = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        known = (self.pairs[found] == wanted) & (left >= 0) & (right >= 0)
        return np.where(known, self.pair_ranks[found] << _SHIFT | at, _NONE)

    def merge_together(self, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
        """Ids of matches of at most ``width`` - 2 bytes each: place 0 and the last one stay empty, so every place has neighbours."""
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        places = np.arange(width)[:, None]
        padded = np.frombuffer(b"".join(b"\0" + p.ljust(width - 1, b"\0") for p in pieces), np.uint8).reshape(n, width).T
        ids = np.where((places > 0) & (places <= lengths), self.byte_ids[padded], -1)
        after, before = np.repeat(places + 1, n, 1), np.repeat(places - 1, n, 1)
        keys = np.full((width, n), _NONE)
        keys[:-1] = self.pair_keys(ids[:-1], ids[1:], places[:-1])
        trees = PairRankTrees(keys)
        live = np.arange(n)
        while True:
            least = trees.least(live)
            more = least != _NONE
            live, least = live[more], least[more]
            if not len(live):
                break
            at, rank = least & (1 << _SHIFT) - 1, least >> _SHIFT
            dead = after[at, live]
            right, left = after[dead, live], before[at, live]
            ids[at, live], ids[dead, live] = rank, -1
            after[at, live], before[right, live] = right, at
            trees.update(dead, live, np.full(len(live), _NONE))
            trees.update(at, live, self.pair_keys(rank, ids[right, live], at))
            trees.update(left, live, self.pair_keys(ids[left, live], rank, left))
        ids = ids.T
        flat, ends = ids[ids >= 0].tolist(), np.cumsum((ids >= 0).sum(axis=1)).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    def learn(self, matches: set[str]) -> None:
        """Remember the ids of matches that are new. When they would become too many, a new generation begins; of the one before, what comes again is taken over."""
        new = matches - self.remembered.keys()
        if len(self.remembered) + len(new) > CACHED_MATCHES:
            self.older, self.remembered, new = self.remembered, {}, matches
        if self.older:
            again = new & self.older.keys()
            self.remembered.update(zip(again, map(self.older.__getitem__, again), strict=True))
            new = new - again
        known, together = self.remembered, {w: ([], []) for w in _WIDTHS}
        for match in new:
            piece = match.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(piece)
            if whole is not None:
                known[match] = (whole,)
            elif len(piece) > _WIDTHS[-1] - 2:
                known[match] = tuple(self.merge(piece))
            else:
                names, pieces = together[next(w for w in _WIDTHS if len(piece) <= w - 2)]
                names.append(match)
                pieces.append(piece)
        for width, (names, pieces) in together.items():
            step = _LEAVES_AT_ONCE // width
            for at in range(0, len(names), step):
                known.update(zip(names[at : at + step], self.merge_together(pieces[at : at + step], width), strict=True))

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one match, by joining the leftmost pair of lowest rank until no pair has one."""
        n, ranks = len(piece), self.ranks
        if n < 2:
            return [ranks[piece]] if piece else []
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        keys = []
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            keys.append(_NONE if rank is None else rank << _SHIFT | i)
        tree = PairRanks(keys)

        def key(i: int) -> int:
            if end[i] == n:
                return _NONE
            rank = ranks.get(piece[i : end[end[i]]])
            return _NONE if rank is None else rank << _SHIFT | i

        while (least := tree.least()) != _NONE:
            at = least & (1 << _SHIFT) - 1
            dead = end[at]
            end[at] = end[dead]
            if end[dead] < n:
                before[end[dead]] = at
            if dead < n - 1:
                tree.update(dead, _NONE)
            tree.update(at, key(at))
            if at:
                tree.update(before[at], key(before[at]))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : end[i]]])
            i = end[i]
        return ids

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text."""
        at = 0
        while at < len(texts):
            chars, end = len(texts[at]), at + 1
            while end < len(texts) and chars + len(texts[end]) <= CHARS_AT_ONCE:
                chars += len(texts[end])
                end += 1
            found = [self.find(t) for t in texts[at:end]]
            self.learn(set(chain.from_iterable(found)))
            for matches in found:
                yield list(chain.from_iterable(map(self.remembered.__getitem__, matches)))
            at = end

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_ready: dict[str, ByteBpe] = {}


def _codec(path: str, shared) -> ByteBpe:
    if path not in _ready:
        _ready.clear()
        _ready[path] = ByteBpe(*shared.value)
    return _ready[path]


def encode_decode(df: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ids (array of int) and decoded (binary, from these ids) to each row.

    Null and empty texts give no ids and no bytes; special strings are plain
    text; texts of any length are encoded whole. ``keep`` as in the other
    operators.
    """
    ranks = read_ranks(path)
    shared = share(df.sparkSession, (ranks, pattern), sum(len(t) + 50 for t in ranks))
    fields = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])

    def make():
        codec = _codec(path, shared)

        def work(texts: list) -> list[pa.Array]:
            ids = list(codec.encode_all([t or "" for t in texts]))
            offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
            return [
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                pa.array([codec.decode(x) for x in ids], pa.binary()),
            ]

        return work

    return append_from_text(df, text, fields, make, keep)


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)
