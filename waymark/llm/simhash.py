"""SimHash near-duplicates by covering anchor points.

Two fingerprints that differ in at most 3 of 64 bits differ in at most one bit in
one of their 32-bit halves. The anchors of a half are the words of the perfect
Hamming code of length 31 (covering radius 1; the top bit is left out). Each half
is at home at the one anchor within the covering radius, and is replicated to all
16 anchors within covering radius plus threshold, 1 + 1. So the home anchor of
one of any two linked fingerprints holds the other, and it is enough to compare
the fingerprints at home in an anchor with all that are replicated to it.
The code has 2**26 words, so anchors stay small with billions of fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import append_from_text, checkpointed, join_hot, quoted

SHINGLE, SEED, THRESHOLD = 3, 42, 3
_BITS = 31
#: Fingerprints of an anchor that one task compares.
_AT_HOME = 1 << 14
#: Of larger anchors, fingerprints at home and of all that meet in one task, on average.
_PART_HOME, _PART_ALL = 1 << 12, 1 << 14
#: Shingle hashes whose bits are counted at once.
_AT_ONCE = 1 << 15


def shingle_hashes(text: str) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; fewer words than a shingle are one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in shingles), np.uint64)


def fingerprint(text: str | None) -> int:
    """Bit b is 1 if it is set in over half the shingle hashes; no words: 0. ASCII letters count as lower case."""
    hashes = shingle_hashes(text or "")
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _AT_ONCE):
        part = hashes[at : at + _AT_ONCE].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, text: str = "text", keep: list[str] | None = None, column: str = "fp") -> DataFrame:
    """Append ``column``, the fingerprint as a signed long."""
    fields = T.StructType([T.StructField(column, T.LongType())])

    def make():
        def work(texts: list) -> list[pa.Array]:
            return [pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))]

        return work

    return append_from_text(df, text, fields, make, keep)


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _anchors(word: Column) -> Column:
    """Anchors within 2 bits of a 31-bit word, that at home first.

    The syndrome is the XOR of the positions (1 to 31) of the set bits; flipping
    the bit at that position gives the home anchor, flipping two bits whose
    positions XOR to it gives the 15 others.
    """
    syndrome = F.lit(0).cast("long")
    for bit in range(5):
        positions = sum(1 << (p - 1) for p in range(1, _BITS + 1) if p >> bit & 1)
        odd = F.bit_count(word.bitwiseAND(F.lit(positions).cast("long"))).cast("long") % 2
        syndrome = syndrome + odd * (1 << bit)

    def flipped(word, *positions):
        for p in positions:
            word = word.bitwiseXOR(F.when(p > 0, F.call_function("shiftleft", F.lit(1).cast("long"), (p - 1).cast("int"))).otherwise(F.lit(0).cast("long")))
        return word

    pairs = F.transform(
        F.filter(F.sequence(F.lit(1).cast("long"), F.lit(_BITS).cast("long")), lambda i: (syndrome > 0) & (i < i.bitwiseXOR(syndrome))),
        lambda i: flipped(word, i, i.bitwiseXOR(syndrome)),
    )
    return F.concat(F.array(flipped(word, syndrome)), pairs)


def replicated(fps: DataFrame) -> DataFrame:
    """Rows (half, anchor, guest, fp): each distinct fp at its home anchors (guest 0) and at the others in reach (guest 1)."""
    mask = F.lit((1 << _BITS) - 1).cast("long")
    # each row becomes 32: a number of partitions that is told isn't merged for being small
    spread = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    halves = spread.select("fp", F.posexplode(F.array(F.col("fp").bitwiseAND(mask), F.shiftrightunsigned("fp", 32).bitwiseAND(mask))).alias("half", "word"))
    return halves.select("half", "fp", F.posexplode(_anchors(F.col("word"))).alias("nth", "anchor")).select(
        "half", "anchor", (F.col("nth") > 0).cast("int").alias("guest"), "fp"
    )


def _spanning(home: np.ndarray, others: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links that connect what the links between ``home`` and all fingerprints of one anchor connect."""
    members = np.concatenate([home, others])
    bits = members.view(np.uint64)  # of signed numbers numpy would count the bits of the absolute value
    group = np.arange(len(members))
    links: list[tuple[int, int]] = []
    for i in range(len(home)):
        near = np.bitwise_count(bits ^ bits[i]) <= threshold
        found = np.unique(group[near])
        if len(found) > 1:
            links += [(int(members[found[0]]), int(members[g])) for g in found[1:]]
            if len(found) == 2:
                group[group == found[1]] = found[0]
            else:
                group[np.isin(group, found[1:])] = found[0]
    return links


def _compare(threshold: int, most: int | None):
    """Batches (key columns, guest, fp), sorted, to links (a, b); the rows of keys with over ``most`` members come back instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        held: list[list[np.ndarray]] = []  # rows of the key that may go on in the next batch
        size, crowded = 0, None

        def starts_of(columns: list[np.ndarray]) -> np.ndarray:
            new = np.zeros(len(columns[0]) - 1, bool)
            for c in columns[:-2]:
                new |= c[1:] != c[:-1]
            return np.flatnonzero(np.r_[True, new])

        def out(found: list[tuple[int, int]], back: list[list[np.ndarray]]) -> pa.RecordBatch:
            links = np.array(found, np.int64).reshape(-1, 2)
            rest = [np.concatenate(c) for c in zip(*back, strict=True)] if back else [np.zeros(0, np.int64)] * len(names)
            n, m = len(links), len(rest[0])
            no_link, no_row = np.r_[np.zeros(n, bool), np.ones(m, bool)], np.r_[np.ones(n, bool), np.zeros(m, bool)]
            columns = [pa.array(np.r_[links[:, k], np.zeros(m, np.int64)], mask=no_link) for k in (0, 1)]
            columns += [pa.array(np.r_[np.zeros(n, np.int64), c], mask=no_row) for c in rest]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b", *names])

        def compared(columns: list[np.ndarray]) -> pa.RecordBatch:
            *_, guest, fp = columns
            starts = starts_of(columns)
            ends, homes = np.r_[starts[1:], len(fp)], np.add.reduceat(1 - guest, starts)
            found, back = [], []
            for i in np.flatnonzero((homes > 0) & (ends - starts > 1)).tolist():
                s, m, e = starts[i], starts[i] + homes[i], ends[i]
                if most is not None and e - s > most:
                    back.append([c[s:e] for c in columns])
                else:
                    found += _spanning(fp[s:m], fp[m:e], threshold)
            return out(found, back)

        for batch in batches:
            names = batch.schema.names
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if crowded is not None and batch.num_rows:
                alike = np.all([c == k for c, k in zip(columns[:-2], crowded, strict=True)], axis=0)
                lead = batch.num_rows if alike.all() else int(np.argmin(alike))
                if lead:
                    yield out([], [[c[:lead] for c in columns]])
                columns = [c[lead:] for c in columns]
                crowded = crowded if lead == batch.num_rows else None
            if not len(columns[0]):
                continue
            cut = int(starts_of(columns)[-1])
            goes_on = bool(held) and all(h[0] == c[-1] for h, c in zip(held[0][:-2], columns[:-2], strict=True))
            if cut or held and not goes_on:
                whole = [*held, [c[:cut] for c in columns]] if cut else held
                yield compared([np.concatenate(c) for c in zip(*whole, strict=True)])
                held, size = [], 0
            held.append([c[cut:] for c in columns])
            size += len(columns[0]) - cut
            if most is not None and size > most:  # too many to hold: given back as they come
                yield out([], held)
                crowded, held, size = [c[0] for c in held[0][:-2]], [], 0
        if held:
            yield compared([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def _dealt(crowded: DataFrame) -> DataFrame:
    """(half, anchor, home_part, all_part, guest, fp): each part of an anchor's fingerprints at home with each part of all, sorted."""
    size = F.count("*")
    parts = checkpointed(
        crowded.groupBy("half", "anchor").agg(
            F.ceil(F.count_if(F.col("guest") == 0) / _PART_HOME).alias("homes"), F.ceil(size / _PART_ALL).alias("alls")
        )
    )  # few: an anchor is crowded from _AT_HOME fingerprints on
    dealt = crowded.join(parts.where("homes > 0"), ["half", "anchor"])

    def side(rows: DataFrame, guest: int, own: str, seed: int, other: str) -> DataFrame:
        """Rows in their own part, once for each part of the other side."""
        part = F.pmod(F.xxhash64("fp", F.lit(seed)), F.col(own))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        named = {own: part, other: every}
        return rows.select("half", "anchor", named["homes"].alias("home_part"), named["alls"].alias("all_part"), F.lit(guest).cast("long").alias("guest"), "fp")

    pairs = side(dealt.where("guest = 0"), 0, "homes", 1, "alls").unionByName(side(dealt, 1, "alls", 2, "homes"))
    keys = ["half", "anchor", "home_part", "all_part"]
    return pairs.repartition(*keys).sortWithinPartitions(*keys, "guest")


def links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that have the same connected components as all pairs within ``threshold`` (at most 3).

    Each anchor's rows come sorted, those at home first; an anchor gives at most
    one link less than it holds fingerprints, never all pairs. Anchors with very
    many fingerprints are compared in a second step by many tasks, each with a
    part of those at home against a part of all, so what a task holds is bounded.
    """
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError("the anchors reach fingerprints that differ in at most 3 bits")
    rows = replicated(fps).select(F.col("half").cast("long").alias("half"), "anchor", F.col("guest").cast("long").alias("guest"), "fp")
    rows = rows.repartition("half", "anchor").sortWithinPartitions("half", "anchor", "guest")
    first = checkpointed(rows.mapInArrow(_compare(threshold, _AT_HOME), "a long, b long, half long, anchor long, guest long, fp long"))
    found, crowded = first.where("a is not null").select("a", "b"), first.where("fp is not null").select("half", "anchor", "guest", "fp")
    if crowded.isEmpty():
        return found
    pairs = _dealt(crowded)
    more = pairs.mapInArrow(_compare(threshold, None), "a long, b long, half long, anchor long, home_part long, all_part long, guest long, fp long")
    return found.unionByName(more.where("a <> b").select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node of the connected component, for each node of ``edges`` (a, b).

    Alternating star steps: neighbours move to the smallest neighbour until only
    stars are left. Each round is written to the checkpoint folder.
    """
    edges = checkpointed(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e")
        )
        edges = checkpointed(small.select("e.u", "e.v").where("u <> v").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct())


def _rooted(prints: DataFrame, threshold: int) -> DataFrame:
    """(fp, first_id, root, component_id) of each distinct fingerprint of (doc_id, fp)."""
    classes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(classes.select("fp"), threshold))
    rooted = checkpointed(classes.join(roots, classes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    smallest = checkpointed(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    return checkpointed(join_hot(rooted, smallest, "root"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links).

    Equal fingerprints are collapsed first, so exact copies never multiply.
    Documents without words share the fingerprint zero and are linked like any
    other; very long texts are read whole. Rows with a null id get the smallest
    id of their component, null if it has none. Repeated rows stay repeated.
    """
    ids = df.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("text"))
    prints = checkpointed(fingerprints(ids, "text", keep=["doc_id"]))
    by_print = _rooted(prints, threshold).select("fp", "component_id")
    return join_hot(prints, by_print, "fp").select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """Documents without the near-duplicates of another: of each component one row of its smallest doc_id stays.

    Rows are told apart by id and fingerprint: unrelated texts under one id are
    documents of their own. A component without any id keeps one row too. Of
    rows with equal id and fingerprint the one with the first text stays.
    """
    key = F.col(quoted(doc_id))
    ids = docs.select(key.alias("doc_id"), F.col(quoted(text)).alias("text"))
    prints = checkpointed(fingerprints(ids, "text", keep=["doc_id"]))
    rooted = _rooted(prints, threshold)
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "fp")).alias("w"))
    winners = checkpointed(first.select(F.col("w.first_id").alias("\u0001id"), F.col("w.fp").alias("\u0001fp")))
    rows_of = prints.groupBy(F.col("doc_id").alias("\u0001id")).agg(F.count("*").alias("\u0001rows"))
    alone = winners.join(rows_of.where("`\u0001rows` = 1"), "\u0001id").select("\u0001id")
    once = docs.join(alone, key == F.col("\u0001id"), "left_semi")
    repeated = checkpointed(winners.join(alone, "\u0001id", "left_anti"))
    if repeated.isEmpty():
        return once
    # an id of several rows, or none: the rows of the winning fingerprint
    some = docs.join(repeated.where("`\u0001id` is not null").select("\u0001id").distinct(), key == F.col("\u0001id"), "left_semi")
    named = fingerprints(some.unionByName(docs.where(key.isNull())), text, column="\u0001f")
    wanted = named.join(repeated, key.eqNullSafe(F.col("\u0001id")) & (F.col("\u0001f") == F.col("\u0001fp")), "left_semi")
    best = wanted.groupBy(key.alias("\u0001id"), "\u0001f").agg(F.min_by(F.struct(*[F.col(quoted(c)) for c in docs.columns]), F.coalesce(F.col(quoted(text)), F.lit(""))).alias("\u0001row"))
    return once.unionByName(best.select("\u0001row.*"))
