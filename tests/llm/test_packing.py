"""Packing against the tokenizer library and a plain rewrite of its rules."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from waymark.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "\n\t", "Don't STOP! it's 3.5°C, naïve ÉTÉ; ok?!", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "x" * 9000, "a b " * 5000, "日本語 テキスト　​ ΣΑΣ İstanbul ﬁne ét", "\x1c a\x0bb\x0cc \x85 d e", "a.b c.. 'tis '' ?! ª º µ ß ſ ǅ"]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def check(rows, texts, capacity):
    """Every id of every text lies in one piece, and sequences are gapless and full."""
    lib, by_doc, by_sequence = library(), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for i, text in texts.items():
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            part = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part) if "ids_crc32" in r.__fields__ else bytes(r.ids) == part
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity and at & (at - 1) == 0  # none is padded
    return by_sequence


def test_query(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    check(queries.op11_packing(spark, data).collect(), texts, 2048)


def test_odd_rows(spark):
    df = spark.createDataFrame([(t, i, "x", 7) for i, t in enumerate(ODD)], "text string, doc_id int, ids string, offset int")
    for capacity in (8, 2048):
        rows = packing.pack(df, PATH, capacity).collect()
        check(rows, dict(enumerate(ODD)), capacity)
    assert packing.pack(df, PATH).columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    twice = packing.pack(spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None)], "doc_id long, text string"), PATH).collect()
    assert sorted((r.doc_id or 0, r.length) for r in twice if r.start == 0 and r.length == r.doc_tokens) and sum(r.length for r in twice) == 7
    assert packing.pack(df.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, PATH, capacity=1000)


def test_words_alone(data):
    with pytest.raises(ValueError):
        packing.WordIds(public_tokenizers.path("byte_bpe_50k.json"))
    words = packing.WordIds(PATH)
    lib = library()
    for t in ODD:
        ids, sizes = words.batch([t or "", "again", t or ""])
        assert ids[: sizes[0]].tolist() == lib.encode(t or "", add_special_tokens=False).ids and sizes[0] == sizes[2]


def plain_assign(lengths, capacities):
    """The rule of ``assign`` written with sorted lists."""
    open_ = [[0.0, s, c] for s, c in enumerate(capacities)]
    where, waiting = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [o for o in sorted(open_) if o[2] >= lengths[i]]
        if not fits:
            waiting.append(i)
            continue
        where.append((i, 0, lengths[i], fits[0][1]))
        fits[0][0] += lengths[i] + lengths[i] ** 2 / 2048
        fits[0][2] -= lengths[i]
    for i in waiting:
        start = 0
        while start < lengths[i] and any(o[2] for o in open_):
            o = min(o for o in open_ if o[2])
            n = min(o[2], lengths[i] - start)
            where.append((i, start, n, o[1]))
            o[0] += n + n**2 / 2048
            o[2] -= n
            start += n
    return where


def test_cost_balance():
    rng = np.random.default_rng(5)
    for k in range(20):
        lengths = np.minimum(rng.lognormal(5, 1.3, 300).astype(int) + 1, 2047)
        if k < 5:
            lengths[:] = lengths[0]  # ties
        total = int(lengths.sum())
        capacities = [2048] * (total // 2048) + (packing.powers(total % 2048) if k % 2 else [])
        parts, rest = packing.assign(lengths, capacities)
        assert [p[:4] for p in parts] == plain_assign(lengths.tolist(), capacities)
        assert sum(p[2] for p in parts) == sum(capacities) and sum(lengths[i] - at for i, at in rest) == total - sum(capacities)
    # where no piece fills a sequence alone, costs come out closer to each other than in the order of arrival
    lengths = np.minimum(lengths, 600)
    total = int(lengths.sum())
    capacities = [2048] * (total // 2048)
    parts, _ = packing.assign(lengths, capacities)
    cost, naive = np.zeros(len(capacities)), np.zeros(total // 2048 + 1)
    for _, _, n, s, _ in parts:
        cost[s] += n + n * n / 2048
    at = 0
    for n in lengths.tolist():
        while n:
            take = min(n, 2048 - at % 2048)
            naive[at // 2048] += take + take * take / 2048
            at, n = at + take, n - take
    assert cost.std() < naive[:-1].std() / 2


def test_sequences(spark):
    docs = spark.createDataFrame([(i, "word " * (7 * i % 90)) for i in range(40)], "doc_id long, text string")
    pieces = packing.pack(docs, PATH, capacity=64)
    rows = packing.sequences(pieces, 64).collect()
    assert sum(r.n_tokens for r in rows) == sum(r.length for r in pieces.collect())
    for r in rows:
        assert len(r.ids) == 4 * r.n_tokens and sum(r.lengths) == r.n_tokens and r.cost > 0
    three = pieces.where("length >= 3").limit(1).withColumns({"length": packing.F.lit(3), "ids": packing.F.substring("ids", 1, 12), "offset": packing.F.lit(0)})
    (r,) = packing.sequences(three, 64, pad_id=5).collect()
    assert len(r.ids) == 256 and set(np.frombuffer(bytes(r.ids), "<u4")[3:]) == {5}


def test_portions_by_size(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "TEXT_AT_ONCE", 10)
    texts = pa.array(["aaaa", None, "bbbbbb", "c", "d" * 50, "", "e" * 9, "f", "g"])
    assert list(packing._portions(texts)) == [(0, 3), (3, 4), (4, 5), (5, 8), (8, 9)]
    assert list(packing._portions(texts.slice(3, 2))) == [(0, 1), (1, 2)] and not list(packing._portions(texts[:0]))
