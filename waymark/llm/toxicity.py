"""Toxicity by a weighted lexicon.

Words and word beginnings are weighed by their log-odds between toxic and clean
training texts. Texts are folded (compatibility forms, homoglyphs, digits that
stand for letters), the lexicon is matched in one pass of an Aho-Corasick
automaton, hits inside exception phrases are dropped, and the summed weight is
normalised by length before a logistic function turns it into a score.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import append_from_text, checkpointed, quoted, share

#: Training rows of each class at most. With MIN_SHARE this bounds the terms too: a term needs so many of the rows, and a row has only so many words.
TRAIN_ROWS = 10_000
#: Lengths of the word beginnings that may become terms.
BEGINNINGS = (4, 5, 6)
#: A term needs this share of the toxic training texts (and 5 of them) and this log-odds.
MIN_SHARE, MIN_WEIGHT = 0.01, 3.0
#: A phrase of a term's word and a neighbour is an exception if so many clean training texts have it, and toxic ones hardly do.
MIN_CLEAN, MAX_EXCEPTION_WEIGHT = 3, -1.0
#: Harmless phrases around words that a lexicon may hold, besides those that are learned.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "pond scum", "stupid simple")
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"}
#: Letters of other scripts that look like Latin ones.
_LOOKALIKE = dict(
    zip("авекмнорстухіјѕԁԛԝһӏɡɑαβεηικνορτυχωϲ", "abekmhopctyxijsdqwhlgaabenikvoptuxwc", strict=True)
)
_GONE = dict.fromkeys(["­", "​", "‌", "‍", "⁠", "﻿"])
_FOLD = str.maketrans(_LOOKALIKE | _GONE)
_WORD = re.compile(r"[^\W_]+(?:[@$!|][^\W_]+)*")
_INNER = str.maketrans(_DIGITS)
_SIGN = re.compile(r"[0-9@$!|]")


def _plain(word: str) -> str:
    """Digits and signs become letters in words that have a letter; numbers stay."""
    return word.translate(_INNER) if _SIGN.search(word) and not word.isdigit() else word


def folded_words(text: str) -> list[str]:
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_FOLD)
    words = _WORD.findall(text)
    return [_plain(w) for w in words] if _SIGN.search(text) else words


@dataclass
class Lexicon:
    """weights: of terms as matched in " word word ": " word " or a beginning " wo"; model: intercept and one weight a feature."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    model: tuple[float, ...] = (-3.0, 2.0, 1.0, 1.0)
    automaton: ahocorasick.Automaton = field(init=False, repr=False, compare=False, default=None)

    def __getstate__(self):
        return self.__dict__ | {"automaton": None}

    def ready(self) -> ahocorasick.Automaton:
        if self.automaton is None:
            a = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                a.add_word(term, (len(term), weight))
            for phrase in self.exceptions:
                a.add_word(key := f" {' '.join(folded_words(phrase))} ", (len(key), None))
            a.make_automaton() if len(a) else None
            self.automaton = a
        return self.automaton

    def n_bytes(self) -> int:
        """Bound of what a broadcast of it takes; the automaton is built by the workers."""
        return 1000 + sum(4 * len(t) + 60 for t in (*self.weights, *self.exceptions))

    def phrases(self, text: str | None) -> set[str]:
        """Each word with a hit, with the word before and with the word after it."""
        words = folded_words(text or "")
        automaton = self.ready()
        if not words or not len(automaton):
            return set()
        line, found = f" {' '.join(words)} ", set()
        starts = np.cumsum([0, *(len(w) + 1 for w in words)]).tolist()  # of the blank before each word
        for end, (length, weight) in automaton.iter(line):
            k = bisect.bisect_right(starts, end - length + 1) - 1
            if weight is not None:
                found.update(" ".join(words[i : i + 2]) for i in (k - 1, k) if i >= 0 and i + 2 <= len(words))
        return found

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Any hit; logarithms of the summed weight and of the weight per 100 words."""
        words = folded_words(text or "")
        automaton = self.ready()
        if not words or not len(automaton):
            return 0.0, 0.0, 0.0
        hits: dict[int, float] = {}  # by word start: only the heaviest term of a word counts
        spared: list[tuple[int, int]] = []
        for end, (length, weight) in automaton.iter(f" {' '.join(words)} "):
            start = end - length + 1
            if weight is None:
                spared.append((start, end))
            elif weight > hits.get(start, 0.0):
                hits[start] = weight
        total, reach, k = 0.0, 0, 0  # reach: end of the exceptions that start up to here
        spared.sort()
        for at, weight in sorted(hits.items()):
            while k < len(spared) and spared[k][0] <= at:
                reach, k = max(reach, spared[k][1]), k + 1
            if at >= reach:
                total += weight
        return float(total > 0), math.log1p(total), math.log1p(100 * total / len(words))

    def score(self, text: str | None) -> float:
        bias, *slopes = self.model
        z = bias + sum(w * x for w, x in zip(slopes, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(toxic, text) of at most about ``rows`` labelled documents a class, none of them held out, equal texts once.

    Rows are chosen by a hash of their id, so the choice doesn't depend on
    partitions or order.
    """
    usable = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    counts = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share_of = F.lit(0.0)
    for toxic, n in counts.items():
        share_of = F.when(F.col("toxic") == toxic, F.lit(min(1.0, rows / n))).otherwise(share_of)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = usable.where(place < share_of)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    # about 2 * rows ids: a bound of under 1 MB
    found = texts.join(F.broadcast(chosen), "doc_id")
    # equal texts with both labels count as toxic, as equal ids do
    return checkpointed(found.groupBy("text").agg(F.max("toxic").cast("int").alias("toxic")).select("toxic", "text"))


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Fit terms, weights and the logistic function on the training rows."""
    train = training_rows(docs, labels, rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = set(folded_words(text))
                seen[toxic].update({f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in BEGINNINGS if len(w) > n})
        for toxic, counter in seen.items():
            items = list(counter.items())
            for at in range(0, len(items), 20_000):
                part = items[at : at + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([toxic] * len(part), pa.int32()), pa.array([t for t, _ in part]), pa.array([n for _, n in part], pa.int64())],
                    names=["toxic", "term", "n"],
                )

    totals = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon({}, exceptions)
    counted = train.mapInArrow(count, "toxic int, term string, n long").groupBy("term").agg(
        F.coalesce(F.sum(F.when(F.col("toxic") == 1, F.col("n"))), F.lit(0)).alias("bad"),
        F.coalesce(F.sum(F.when(F.col("toxic") == 0, F.col("n"))), F.lit(0)).alias("good"),
    )
    weight = F.log((F.col("bad") + 0.5) / (n_toxic + 1)) - F.log((F.col("good") + 0.5) / (n_clean + 1))
    terms = (
        counted.withColumn("weight", weight)
        .where((F.col("bad") >= max(5, MIN_SHARE * n_toxic)) & (F.col("weight") >= MIN_WEIGHT))
        .select("term", "weight", "bad", "good")
        .collect()
    )
    lexicon = Lexicon(_without_spans({r["term"]: (r["weight"], r["bad"]) for r in terms}), exceptions)
    lexicon.exceptions = (*exceptions, *learned_exceptions(train, lexicon, n_toxic, n_clean))
    shared = share(docs.sparkSession, lexicon, lexicon.n_bytes())
    fields = T.StructType([T.StructField(f"x{i}", T.DoubleType()) for i in range(3)])

    def make():
        found = shared.value.features
        return lambda texts: [pa.array(c, pa.float64()) for c in zip(*map(found, texts), strict=True)] if texts else [pa.array([], pa.float64())] * 3

    seen = np.array([tuple(r) for r in append_from_text(train, "text", fields, make, keep=["toxic"]).collect()], float).reshape(-1, 4)
    lexicon.model = fit_logistic(seen[:, 1:], seen[:, 0])
    return lexicon


def learned_exceptions(train: DataFrame, lexicon: Lexicon, n_toxic: int, n_clean: int) -> list[str]:
    """Two-word phrases around hits of the lexicon that are a mark of clean texts."""
    shared = share(train.sparkSession, lexicon, lexicon.n_bytes())

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value.phrases
        for batch in batches:
            rows = [(toxic, p) for toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for p in sorted(find(text))]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.string())], names=["toxic", "phrase"])

    counts = train.mapInArrow(phrases, "toxic int, phrase string").groupBy("phrase").agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good"))
    weight = F.log((F.col("bad") + 0.5) / (n_toxic + 1)) - F.log((F.col("good") + 0.5) / (n_clean + 1))
    return sorted(r["phrase"] for r in counts.where((F.col("good") >= MIN_CLEAN) & (weight <= MAX_EXCEPTION_WEIGHT)).select("phrase").collect())


def _without_spans(terms: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Leave out whole words and longer beginnings that a shorter beginning covers as purely."""
    kept: dict[str, tuple[float, int]] = {}
    for term, (weight, bad) in sorted(terms.items(), key=lambda x: (len(x[0]), x[0])):
        stems = (term[:n] for n in range(2, len(term)))
        if not any(s in kept and kept[s][0] >= weight for s in stems):
            kept[term] = (weight, bad)
    return {t: w for t, (w, _) in kept.items()}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> tuple[float, ...]:
    """Newton steps for ridge-penalised logistic regression; both classes weigh the same."""
    x = np.column_stack([np.ones(len(x)), x])
    share_of = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(x.shape[1])
    penalty = ridge * np.r_[0.0, np.ones(x.shape[1] - 1)]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share_of * (p - y)) + penalty * w
        bend = (x * (share_of * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-6)
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def score_texts(df: DataFrame, lexicon: Lexicon, text: str = "text", column: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Append ``column``, 0 to 1, higher where label 1 is likelier.

    Null and empty texts get the score of a text without hits; long texts are
    matched whole.
    """
    shared = share(df.sparkSession, lexicon, lexicon.n_bytes())
    fields = T.StructType([T.StructField(column, T.DoubleType())])

    def make():
        score = shared.value.score
        return lambda texts: [pa.array([score(t) for t in texts], pa.float64())]

    return append_from_text(df, text, fields, make, keep)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from ``threshold`` on) of each document.

    Null and empty texts score as texts without hits, very long ones are matched
    whole; repeated rows stay and score alike; rows without an id aren't held
    out and are never learned from. Without labels of both classes nothing is
    toxic.
    """
    scored = score_texts(docs.select("doc_id", "text"), learn(docs, labels), keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Documents that score under ``threshold``, with the columns they had."""
    scored = score_texts(docs, learn(docs, labels), column="\u0001score")
    return scored.where(F.col("\u0001score") < threshold).select(*[F.col(quoted(c)) for c in docs.columns])
