"""The URL classifier fitted on a table of labelled URLs, judged on others."""

import math
import random
from collections import Counter

import pytest

from waymark.llm import url_filter

BAD = "zorblax frimtok quandle vexomir droptang slithe krumble wobbex".split()
GOOD = "harrow lintel pagoda quiver saddle turnip velvet walnut".split()
BOTH = "alpha river stone cloud".split()


def urls(n, seed):
    """Names run together of two words of a kind and one of neither; none is in the default lists."""
    rng, out = random.Random(seed), []
    for i in range(n):
        kind = rng.choice(["allow", "block", "allow"])
        words = [*rng.sample(BAD if kind == "block" else GOOD, 2), rng.choice(BOTH)]
        rng.shuffle(words)
        path = f"/{rng.choice(BOTH)}/{rng.choice(words)}-{i}" if rng.random() < 0.7 else ""
        out.append((f"https://www.{''.join(words)}.org{path}?id={i}", kind))
    return out


@pytest.fixture(scope="module")
def judged(spark):
    known = set(" ".join((url_filter.ALLOWED, url_filter.BLOCKED)).replace("-", " ").split())
    assert not known & {*BAD, *GOOD}
    train, test = urls(400, 1), urls(150, 2)
    seen = {u for u, _ in train}
    test = [t for t in test if t[0] not in seen]
    labelled = spark.createDataFrame([*train, ("https://x.org", None), (None, "allow"), ("https://y.org", "maybe")], "url string, verdict string")
    rows = [(i, u, "") for i, (u, _) in enumerate(test)] + [(10_000, None, ""), (10_001, "https://unheard.of/", ""), (0, test[0][0], "")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, words string")
    return train, test, url_filter.judge(pages, [("allow", "com/")], labelled=labelled).collect()


def test_held_out_urls(judged):
    _, test, rows = judged
    got = {r.page_id: r for r in rows}
    right = sum(got[i].verdict == kind for i, (_, kind) in enumerate(test))
    assert right >= 0.97 * len(test)
    assert got[10_000].verdict == got[10_001].verdict == "allow" and len(rows) == len(test) + 3
    assert len({r.score for r in rows if r.page_id == 0}) == 1
    # names run together come apart into the words that paths have
    split = sum({*r.words} & {*BAD, *GOOD} != set() for r in rows)
    assert split >= 0.97 * len(test)


def test_scores_against_plain_bayes(spark):
    """The same scores as naive Bayes on counted words, for words that a row has twice too."""
    examples = [(["a", "b", "a"], "block"), (["b", "c"], "allow"), (["c"], "allow"), ([], "block")]
    weights, prior = url_filter.learned(spark.createDataFrame(examples, "words array<string>, verdict string"))
    good, bad = (Counter(w for words, v in examples for w in words if v == kind) for kind in ("allow", "block"))
    plain = url_filter.NaiveBayes({w: (good[w], bad[w]) for w in good | bad}, (2, 2))
    assert {r.word: r.weight for r in weights.collect()} == pytest.approx(plain.weights) and prior == plain.prior
    rows = spark.createDataFrame([(1, ["a", "a", "c", "z"]), (2, []), (2, [])], "k long, words array<string>")
    got = sorted((r.k, 1 / (1 + math.exp(-r.z))) for r in url_filter.weighed_by(rows, weights, prior).collect())
    assert [g[1] for g in got] == pytest.approx([plain.score(["a", "a", "c", "z"]), plain.score([]), plain.score([])])


def test_no_labels(spark):
    pages = spark.createDataFrame([(1, "https://a.org/b", "")], "page_id long, url string, html string")
    none = spark.createDataFrame([], "url string, verdict string")
    (r,) = url_filter.judge(pages, [], labelled=none).collect()
    assert (r.score, r.verdict) == (0.5, "block")  # nothing learned: even odds, and a score of the threshold blocks
