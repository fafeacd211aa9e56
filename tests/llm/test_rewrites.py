"""Scores, features and stored forms against plain rewrites; empty tables, repeats and clashing names."""

import hashlib
import math
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from waymark.llm import html_text, media, queries, token_counts, toxicity


def plain_terms(words):
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in toxicity.BEGINNINGS if len(w) > n}


def test_toxicity_scores_against_a_rewrite(spark, data):
    """The whole of op8 once more with dictionaries and loops: what is learned, where it hits, and the score."""
    data = data.replace("sf0.001", "sf0.01")
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    labels = defaultdict(int)
    for r in spark.read.parquet(f"{data}/labels.parquet").collect():
        labels[r.doc_id] = max(labels[r.doc_id], r.toxic)
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    train = {}
    for i, text in docs:
        if i in labels and not held(i):
            train[text] = max(train.get(text, 0), labels[i])
    n = [sum(v == k for v in train.values()) for k in (0, 1)]
    seen = [Counter(), Counter()]
    for text, toxic in train.items():
        seen[toxic].update(plain_terms(set(toxicity.folded_words(text))))
    odds = lambda bad, good: math.log((bad + 0.5) / (n[1] + 1)) - math.log((good + 0.5) / (n[0] + 1))
    terms = {t: odds(bad, seen[0][t]) for t, bad in seen[1].items() if bad >= max(5, toxicity.MIN_SHARE * n[1]) and odds(bad, seen[0][t]) >= toxicity.MIN_WEIGHT}
    kept = {}
    for t in sorted(terms, key=lambda t: (len(t), t)):
        if all(s not in kept or kept[s] < terms[t] for s in (t[:k] for k in range(2, len(t)))):
            kept[t] = terms[t]

    def hits(words):
        """(place of the word, weight) of each word that a term fits; whole words end, beginnings needn't."""
        for k, w in enumerate(words):
            fit = [x for t, x in kept.items() if (t == f" {w} " if t.endswith(" ") else f" {w} ".startswith(t))]
            if fit:
                yield k, max(fit)

    phrases = [Counter(), Counter()]
    for text, toxic in train.items():
        words = toxicity.folded_words(text)
        phrases[toxic].update({" ".join(words[i : i + 2]) for k, _ in hits(words) for i in (k - 1, k) if i >= 0 and i + 2 <= len(words)})
    learned = [p for p, good in phrases[0].items() if good >= toxicity.MIN_CLEAN and odds(phrases[1][p], good) <= toxicity.MAX_EXCEPTION_WEIGHT]
    exceptions = [tuple(toxicity.folded_words(p)) for p in (*toxicity.EXCEPTIONS, *learned)]

    def features(text):
        words = toxicity.folded_words(text)
        spared = {k for e in exceptions for i in range(len(words) - len(e) + 1) if tuple(words[i : i + len(e)]) == e for k in range(i, i + len(e))}
        total = sum(x for k, x in hits(words) if k not in spared)
        return (1.0, float(total > 0), math.log1p(total), math.log1p(100 * total / len(words)) if words else 0.0)

    lexicon = toxicity.learn(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet"))
    assert lexicon.weights == pytest.approx(kept) and kept
    assert set(lexicon.exceptions) == {*toxicity.EXCEPTIONS, *learned}
    # the logistic function is where the slope of its penalised loss is nothing
    x, y = np.array([features(t) for t in train]), np.array(list(train.values()))
    share = np.where(y == 1, 0.5 / n[1], 0.5 / n[0]) * len(y)
    p = 1 / (1 + np.exp(-(x @ lexicon.model)))
    assert np.abs(x.T @ (share * (p - y)) + 0.05 * np.r_[0, lexicon.model[1:]]).max() < 1e-3
    got = {r.doc_id: r for r in queries.op8_toxicity(spark, data).collect()}
    for i, text in docs:
        z = sum(a * b for a, b in zip(lexicon.model, features(text), strict=True))
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
        assert got[i].predicted == int(got[i].score >= 0.7) and got[i].held_out == held(i)


def plain_png(data):
    """(filter types, samples) of a PNG by the book, byte by byte."""
    at, packed = 8, b""
    while at < len(data):
        length, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + length]
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", body)
        packed += body if kind == b"IDAT" else b""
        at += 12 + length
    raw, rows = zlib.decompress(packed), [[0] * width]
    for y in range(height):
        kind, line = raw[y * (width + 1)], raw[y * (width + 1) + 1 : (y + 1) * (width + 1)]
        row = []
        for x, v in enumerate(line):
            row.append((v + (0, row[x - 1] if x else 0, rows[-1][x])[kind]) & 255)
        rows.append(row)
    return rows[1:]


def plain_feature(rows):
    """Sums over areas of the image, then the cosine formula; ties of coefficients and their median are told to six digits."""
    side = media._SIDE
    height, width = len(rows), len(rows[0])

    def shares(length, k):
        return [max(0.0, min((k + 1) * length / side, c + 1) - max(k * length / side, c)) for c in range(length)]

    small = []
    for k in range(side):
        if height > 4 * side:
            chosen = rows[k * height // side : (k + 1) * height // side]
            line = [sum(r[c] for r in chosen) / len(chosen) for c in range(width)]
        else:
            part = shares(height, k)
            line = [sum(p * r[c] for p, r in zip(part, rows, strict=True)) / sum(part) for c in range(width)]
        small.append([sum(p * v for p, v in zip(q, line, strict=True)) / sum(q) for q in (shares(width, j) for j in range(side))])
    cosine = lambda u, i: math.cos((2 * i + 1) * u * math.pi / (2 * side))
    low = [round(sum(small[i][j] * cosine(u, i) * cosine(v, j) for i in range(side) for j in range(side)), 6) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    return f"{int(''.join('01'[c > middle] for c in low), 2):016x}"


def test_media_stored_form_and_feature(spark, data):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op6_media(spark, data).collect()}
    stored = {r.doc_id: bytes(r.media) for r in media.store_as_png(spark.read.parquet(f"{data}/documents.parquet"), keep=["doc_id"]).collect()}
    for i, text in texts.items():
        assert (got[i].media_bytes, got[i].media_sha256) == (len(stored[i]), hashlib.sha256(stored[i]).hexdigest())
    for i in sorted(texts, key=lambda i: len(texts[i]))[:: max(1, len(texts) // 12)]:
        rows = plain_png(stored[i])
        raw = texts[i].encode()
        assert bytes(v for r in rows for v in r) == raw + bytes(-len(raw) % 64 if raw else 64)
        assert got[i].feature == plain_feature(rows)


def test_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y", 3), (1, "a b", "x", "y", 3)], "doc_id long, text string, n_bytes string, feature string, payload_bytes int")
    two = media.read_png(media.store_as_png(docs)).collect()
    assert two[0] == two[1] and (two[0].n_bytes, two[0].payload_bytes) == (3, 64) and len(two[0].feature) == 16
    none = docs.limit(0)
    assert media.read_png(media.store_as_png(none)).count() == 0
    assert token_counts.count_tokens(none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    pages = spark.createDataFrame([(1, "u", "<p>Some words</p>", 5)] * 3, "page_id long, url string, html string, n_chars int")
    assert [(r.text, r.n_chars) for r in html_text.extract_text(pages).collect()] == [("Some words", 10)] * 3
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_other_models_are_refused(tmp_path):
    """A model whose texts are normalised or cut otherwise would be counted wrongly."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    path = public_tokenizers.path("piece_bpe_32k.model")
    assert token_counts.PieceCounter.from_file(path).count("one two") == 2
    given = proto.ModelProto.FromString(open(path, "rb").read())

    def refused(change):
        other = proto.ModelProto()
        other.CopyFrom(given)
        change(other)
        (tmp_path / "m.model").write_bytes(other.SerializeToString())
        with pytest.raises(ValueError, match="can't be counted"):
            token_counts.PieceCounter.from_file(str(tmp_path / "m.model"))

    refused(lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True))
    refused(lambda m: setattr(m.normalizer_spec, "add_dummy_prefix", False))
    refused(lambda m: setattr(m.normalizer_spec, "precompiled_charsmap", b"x"))
    refused(lambda m: setattr(m.trainer_spec, "model_type", proto.TrainerSpec.UNIGRAM))
    refused(lambda m: setattr(m.trainer_spec, "treat_whitespace_as_suffix", True))
    refused(lambda m: setattr(m.pieces[500], "type", proto.ModelProto.SentencePiece.USER_DEFINED))
