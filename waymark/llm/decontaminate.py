"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive tokens; the hash covers the tokens at its
selected places and ignores the others, so a substitution at an ignored place
doesn't matter. The three masks below hit every stretch of 13 to 25 tokens of
which 80 % are equal, wherever the others are (tested over all patterns); longer
stretches can be cut into such pieces, one of which has 80 % equal tokens too.
Items of fewer than 13 tokens have masks of their own length. Hashes of training texts that pass a bitmap
of the benchmark's hashes are joined with them; around each hit the texts are
aligned and the longest stretch with at least 80 % equal tokens is measured.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import BROADCAST_LIMIT, checkpointed, quoted, share

MASKS = ((0, 1, 2, 4, 5, 6), (0, 1, 3, 6, 9, 10), (0, 1, 2, 3, 5, 10))
#: An overlap needs so many tokens (or a whole shorter item), and so large a part of them equal.
MIN_TOKENS, MIN_EQUAL = 13, 0.8
#: Bits of the bitmap that thins out training hashes before the join: 2 MB at any size of benchmark.
BITMAP_BITS = 1 << 24
_BUCKET = 1 << 15
#: Rows with one hash or item are spread over so many keys; the benchmark side is repeated for each.
SALTS = 8
_WORDS = re.compile(r"\w+")
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
                     0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6E6877736C46E3, 0xD1B54A32D192ED03], np.uint64)


def short_masks(n: int, min_equal: float = MIN_EQUAL) -> list[tuple[int, ...]]:
    """Masks over a whole item of ``n`` tokens: whichever of its tokens differ, if enough are equal one mask leaves all those out.

    So many tokens may differ that fall into at most as many of the groups the
    places are dealt to; each mask leaves out one choice of groups.
    """
    differ = int((1 - min_equal) * n + 1e-9)
    groups = n if n < 6 else min(n, differ + 2 + (differ > 1))
    return [tuple(p for p in range(n) if p % groups not in out) for out in itertools.combinations(range(groups), differ)]


def tokens_of(text: str | None) -> np.ndarray:
    """64-bit hashes of the lower-cased words, punctuation left out."""
    words = _WORDS.findall((text or "").lower())
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def seed_hashes(tokens: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hash of the mask at each place where it fits; masks don't share hashes."""
    n = len(tokens) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, sum(1 << p for p in mask), np.uint64)
    for place, factor in zip(mask, _FACTORS[: len(mask)], strict=True):
        out += tokens[place : place + n] * factor
    out ^= out >> np.uint64(32)
    out *= _FACTORS[0]
    return out ^ (out >> np.uint64(29))


def longest_alike(equal: np.ndarray, share_of: float = MIN_EQUAL) -> tuple[int, int]:
    """Start and end of the longest stretch with at least ``share_of`` true; the first of equally long ones."""
    gain = np.concatenate([[0.0], np.cumsum(np.where(equal, 1 - share_of, -share_of))])
    gain = np.round(gain, 9)
    lowest, highest = np.minimum.accumulate(gain), np.maximum.accumulate(gain[::-1])[::-1]
    # the best end for a start grows with the start: walk both forward
    best, end, n = (0, 0), 0, len(equal)
    for start in range(n):
        if start and lowest[start] == lowest[start - 1]:
            continue  # an earlier start is at least as good
        while end < n and highest[end + 1] >= lowest[start]:
            end += 1
        if end - start > best[1] - best[0]:
            best = (start, end)
    return best


def _item_seeds(items: DataFrame, min_tokens: int, min_equal: float) -> DataFrame:
    """(item_id, tokens, seeds array<struct<hash, at>>) of each benchmark item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            all_tokens, all_seeds = [], []
            for text in texts.to_pylist():
                tokens = tokens_of(text)
                masks = MASKS if len(tokens) >= min_tokens else short_masks(len(tokens), min_equal) if len(tokens) else ()
                seeds = [(int(h), i) for m in masks for i, h in enumerate(seed_hashes(tokens, m)[: None if masks is MASKS else 1].view(np.int64))]
                all_tokens.append(tokens.view(np.int64))
                all_seeds.append([{"hash": h, "at": i} for h, i in seeds])
            seed_type = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32())]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(all_tokens, pa.list_(pa.int64())), pa.array(all_seeds, seed_type)], names=["item_id", "tokens", "seeds"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, tokens array<long>, seeds array<struct<hash:long,at:int>>")


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Two bits a hash, gathered by Spark in buckets of 4 KB; 2 MB altogether."""
    mask = F.lit(BITMAP_BITS - 1).cast("long")
    bits = hashes.select(F.explode(F.array(F.col("hash").bitwiseAND(mask), F.shiftrightunsigned("hash", 24).bitwiseAND(mask))).alias("bit"))
    buckets = bits.groupBy(F.floor(F.col("bit") / _BUCKET).alias("bucket")).agg(F.bitmap_construct_agg(F.col("bit") % _BUCKET).alias("bits"))
    out = np.zeros(BITMAP_BITS // 8, np.uint8)
    for row in buckets.collect():  # at most 512 rows
        out[row["bucket"] * _BUCKET // 8 :][: _BUCKET // 8] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out


def _hit_regions(docs: DataFrame, bitmap, context: int, masks: dict[tuple[int, ...], bool]) -> DataFrame:
    """(doc_id, first, tokens, seeds): the stretches of each document around hashes that the bitmap passes.

    Masks with a true value cover their items whole: the first of equal hashes
    in a document is the overlap that is reported, the others are left out.
    """
    shift = np.uint64(24)
    low = np.uint64(BITMAP_BITS - 1)

    def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        a = hashes & low
        at = np.flatnonzero(bits[a >> np.uint64(3)] >> (a & np.uint64(7)).astype(np.uint8) & 1)
        b = (hashes[at] >> shift) & low
        return at[(bits[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8) & 1) > 0]

    def regions(tokens: np.ndarray, bits: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[dict]]]:
        found = []
        for mask, first_only in masks.items():
            hashes = seed_hashes(tokens, mask)
            at = passes(bits, hashes)
            if first_only:
                at = at[np.sort(np.unique(hashes[at], return_index=True)[1])]
            found += zip(at.tolist(), hashes[at].view(np.int64).tolist(), strict=True)
        found.sort()
        i = 0
        while i < len(found):
            j = i + 1
            while j < len(found) and found[j][0] - found[j - 1][0] <= context:
                j += 1
            first = max(0, found[i][0] - context)
            yield first, tokens[first : found[j - 1][0] + context + 1], [{"hash": h, "at": p - first} for p, h in found[i:j]]
            i = j

    seed_type = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            ids, texts = batch.columns
            rows: list[tuple] = []
            for doc, text in zip(ids, texts, strict=True):
                rows += [(doc.as_py(), *r) for r in regions(tokens_of(text.as_py()), bits)]
            if rows:
                doc_ids, firsts, tokens, seeds = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, ids.type),
                        pa.array(firsts, pa.int32()),
                        pa.array([t.view(np.int64) for t in tokens], pa.list_(pa.int64())),
                        pa.array(seeds, seed_type),
                    ],
                    names=["doc_id", "first", "tokens", "seeds"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, first int, tokens array<long>, seeds array<struct<hash:long,at:int>>")


def _measured(candidates: DataFrame, min_tokens: int, min_equal: float) -> DataFrame:
    """Align each candidate at its offset; keep those whose overlap is long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, item, first, shift, theirs, ours = batch.columns
            out: list[tuple] = []
            for i in range(batch.num_rows):
                a, b = theirs[i].values.to_numpy(), ours[i].values.to_numpy()
                offset = shift[i].as_py()  # place in the region of the item's first token
                start, stop = max(0, offset), min(len(a), offset + len(b))
                if stop <= start:
                    continue
                equal = a[start:stop] == b[start - offset : stop - offset]
                s, e = longest_alike(equal, min_equal)
                if e - s >= min(min_tokens, len(b)):
                    out.append((doc[i].as_py(), item[i].as_py(), first[i].as_py() + start + s, start - offset + s, e - s, int(equal[s:e].sum())))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [doc.type, item.type, pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "doc_at", "item_at", "n_tokens", "n_equal"]
            )

    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema.fields}
    rows = candidates.select("doc_id", "item_id", "first", "shift", "theirs", "ours")
    return rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, doc_at long, item_at long, n_tokens long, n_equal long")


def _compared(kinds: DataFrame, seeds: DataFrame, items: DataFrame, min_tokens: int, min_equal: float) -> DataFrame:
    """Overlaps (kind, item_id, doc_at, item_at, n_tokens, n_equal) of the regions and the items of ``seeds`` at the offsets of their hits.

    Only ids and lengths go through the join of the hashes; offsets at which too
    few tokens lie opposite each other end there. The tokens that do are fetched
    afterwards, of a region only those the item covers.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salt = F.pmod(F.xxhash64("region"), F.lit(SALTS)).cast("int").alias("salt")
    hits = kinds.select("region", salt, F.size("tokens").alias("length"), F.explode("seeds").alias("s"))
    shift = F.col("at") - F.col("item_at")
    first = F.greatest(F.lit(0), shift)
    places = (
        hits.select("region", "salt", "length", "s.hash", F.col("s.at").alias("at"))
        .join(seeds.select("*", salts), ["hash", "salt"])
        .select("region", "item", "n", first.alias("first"), (shift - first).alias("shift"), (F.least("length", shift + F.col("n")) - first).alias("opposite"))
        .where(F.col("opposite") >= F.least(F.lit(min_tokens), "n"))
        .distinct()
    )
    theirs = F.slice("theirs", F.col("first") + 1, F.col("opposite")).alias("theirs")
    both = (
        places.join(kinds.select("region", "k1", "k2", salt, F.col("tokens").alias("theirs")), "region")
        .select("item", "salt", F.struct("k1", "k2").alias("doc_id"), "first", "shift", theirs)
        .join(items.select("item", "item_id", F.col("tokens").alias("ours"), salts), ["item", "salt"])
    )
    return checkpointed(_measured(both, min_tokens, min_equal)).withColumnRenamed("doc_id", "kind")


def _hits(docs: DataFrame, benchmark: DataFrame, min_equal: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Regions of the documents (doc_id, text), their kinds, and seeds and tokens of the benchmark's items (item_id, text)."""
    items = checkpointed(_item_seeds(benchmark, MIN_TOKENS, min_equal))
    items = items.withColumn("item", F.monotonically_increasing_id())  # item ids may be null or repeated
    seeds = items.select("item", F.size("tokens").alias("n"), F.explode("seeds").alias("s")).select("item", "n", "s.hash", F.col("s.at").alias("item_at"))
    context, *short = items.agg(F.coalesce(F.max(F.size("tokens")), F.lit(0)), *[F.count_if(F.size("tokens") == n) for n in range(1, MIN_TOKENS)]).first()
    masks = dict.fromkeys(MASKS, False)
    for n, some in enumerate(short, 1):  # only lengths that the benchmark has
        for mask in short_masks(n, min_equal) if some else ():
            masks[mask] = masks.get(mask, True) and len(mask) == n
    bits = _bitmap(seeds)
    assert bits.nbytes <= BROADCAST_LIMIT
    regions = _hit_regions(docs, share(docs.sparkSession, bits, bits.nbytes), context, masks)
    regions = checkpointed(regions.withColumns({"k1": F.xxhash64("tokens", "seeds"), "k2": F.xxhash64(F.lit(1), "tokens", "seeds")}))
    # copies have equal regions: each kind is compared once
    kinds = checkpointed(regions.groupBy("k1", "k2").agg(F.first("tokens").alias("tokens"), F.first("seeds").alias("seeds")))
    return regions.drop("tokens", "seeds"), kinds.withColumn("region", F.monotonically_increasing_id()), seeds, items


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    min_tokens: int = MIN_TOKENS,
    min_equal: float = MIN_EQUAL,
) -> DataFrame:
    """(doc_id, item_id, doc_at, item_at, n_tokens, n_equal): the longest overlap of each document and benchmark item that share one.

    An overlap is an aligned stretch of at least ``min_tokens`` tokens, or of a
    whole shorter item, of which ``min_equal`` are equal. Null and empty texts overlap
    nothing; repeated rows count as one document, rows of one item id as one
    item; rows without an id are reported under a null id.
    """
    if min_tokens < MIN_TOKENS or min_equal < MIN_EQUAL:
        raise ValueError(f"the masks are proven for {MIN_TOKENS} tokens and {MIN_EQUAL} equal or more")
    docs = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("text"))
    benchmark = benchmark.select(F.col(quoted(item_id)).alias("item_id"), F.col(quoted(text)).alias("text"))
    regions, kinds, seeds, items = _hits(docs, benchmark, min_equal)
    found = _compared(kinds, seeds, items, min_tokens, min_equal)
    here = regions.withColumn("salt", F.pmod(F.xxhash64("doc_id", "first"), F.lit(SALTS)).cast("int"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    there = found.select("kind.k1", "kind.k2", "item_id", "doc_at", "item_at", "n_tokens", "n_equal", salts)
    pairs = here.join(there, ["k1", "k2", "salt"]).withColumn("doc_at", F.col("first") + F.col("doc_at"))
    best = F.max(F.struct("n_tokens", "n_equal", (-F.col("doc_at")).alias("d"), (-F.col("item_at")).alias("i"))).alias("b")
    return pairs.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("b.d")).alias("doc_at"), (-F.col("b.i")).alias("item_at"), "b.n_tokens", "b.n_equal"
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents whose text overlaps no benchmark item, with the columns they had.

    Rows are told apart by their texts, so rows without an id are judged as any
    other, and of unrelated rows under one id (``doc_id`` isn't read) only those
    with a leak go. Null and empty texts stay. One overlap is enough to reject a
    text, so the texts first meet one item for each hash, and only those that
    this doesn't reject meet all items: a phrase of many items and many texts
    costs a comparison a text.
    """
    key = F.unhex(F.sha2(F.coalesce(F.col(quoted(text)), F.lit("")).cast("binary"), 256))
    benchmark = benchmark.select("item_id", F.col(quoted(text)).alias("text"))
    regions, kinds, seeds, items = _hits(docs.select(key.alias("doc_id"), F.col(quoted(text)).alias("text")), benchmark, MIN_EQUAL)
    members = checkpointed(regions.select("doc_id", "k1", "k2").distinct())

    def rejected(found: DataFrame) -> DataFrame:
        leaks = found.select("kind.k1", "kind.k2").distinct()
        return checkpointed(members.join(leaks, ["k1", "k2"], "left_semi").select("doc_id").distinct())

    one = seeds.groupBy("hash").agg(F.min(F.struct("item", "n", "item_at")).alias("s")).select("s.item", "s.n", "hash", "s.item_at")
    leaked = rejected(_compared(kinds, one, items, MIN_TOKENS, MIN_EQUAL))
    open_kinds = members.join(leaked, "doc_id", "left_anti").select("k1", "k2").distinct()
    rest = kinds.join(open_kinds, ["k1", "k2"], "left_semi")
    leaked = leaked.unionByName(rejected(_compared(rest, seeds, items, MIN_TOKENS, MIN_EQUAL)))
    return docs.join(leaked.select(F.col("doc_id").alias("\u0001leaked")), key == F.col("\u0001leaked"), "left_anti")
