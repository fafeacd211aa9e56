"""Text operators against the libraries, brute force, round trips and planted cases."""

import base64
import hashlib
import itertools
import math
import random
import re
import struct
import textwrap
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash

from waymark.llm import byte_bpe, common, decontaminate, html_text, licenses, media, pii, queries, simhash, token_counts, toxicity, url_filter

ODD = [None, "", " ", "  a  b ", " ▁ ▁▁x", "a\x00b\n\n\nc\r\n", "x" * 3000, "ab" * 300 + " " * 200 + "yz", "<s></s> <unk> <0x41> <|endoftext|>", "日本語 テキスト　\u200b", "é́ 🎉🎉 don't we'll   \n\n  x"]
#: Names that operators use themselves or produce.
CLASH = "n_tokens string, score string, ids string, fp string, text2 string, spans string, media string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, a repeated row, and extra columns whose names clash."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(1, ""), (None, "lonely words of no document")]
    df = spark.createDataFrame([(i, t, *["x"] * 7) for i, t in rows], f"doc_id long, text string, {CLASH}")
    return df


@pytest.fixture(scope="module")
def texts(spark, data):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}


def by_id(df):
    return {r[0]: r for r in df.collect()}


def test_token_counts(spark, data, texts, odd):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = by_id(queries.op1_token_counts(spark, data))
    for i, t in texts.items():
        n = len(model.encode(t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 4096)
    out = token_counts.count_tokens(odd, path)
    assert out.columns[-3:] == ["n_bytes", "n_tokens", "over_limit"] and out.count() == odd.count()
    assert {r.n_tokens for r in out.where("doc_id = 1").collect()} == {0}
    counter = token_counts.PieceCounter.from_file(path)
    assert all(counter.count(t or "") == len(model.encode(t or "")) for t in ODD)
    word = "".join(random.Random(1).choice("abcdefgh ▁é\n") for _ in range(5000))
    assert counter.count(word) == len(model.encode(word))


def test_byte_bpe(spark, data, texts, odd):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(queries.op3_byte_bpe(spark, data))
    for i, t in texts.items():
        ids = library.encode_ordinary(t or "")
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want
    out = byte_bpe.encode_decode(odd, path, public_tokenizers.PATTERN).collect()
    assert len(out) == odd.count()
    for r in out:
        assert list(r.ids) == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()


def test_segment_tree_is_leftmost():
    tree = byte_bpe.PairRanks([5 << 40 | 0, 3 << 40 | 1, 3 << 40 | 2])
    assert tree.least() == 3 << 40 | 1
    tree.update(1, byte_bpe._NONE)
    assert tree.least() == 3 << 40 | 2


def test_byte_bpe_together_as_alone():
    """Matches of every width, merged many at a time, have the ids that they have alone; so has a vocabulary of bytes only."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    codec, rng = byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN), random.Random(3)
    pieces = [bytes(rng.choices(b"abcdetrs \xc3\xa9\x00\xff0", k=rng.randint(1, 62))) for _ in range(3000)] + [b"a" * n for n in range(1, 63)]
    for width in byte_bpe._WIDTHS:
        fit = [p for p in pieces if len(p) <= width - 2]
        assert codec.merge_together(fit, width) == [tuple(codec.merge(p)) for p in fit]
    single = byte_bpe.ByteBpe({bytes([b]): b for b in range(256)}, public_tokenizers.PATTERN)
    assert single.encode("h\u00e9 " * 3 + "x" * 100) == list(("h\u00e9 " * 3 + "x" * 100).encode())


def test_byte_bpe_forgets(monkeypatch):
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    texts = ["", "zqxj wvkq zqxj", "wvkq " * 5, "one\n\ntwo", "qqzz" * 40]
    want = list(byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN).encode_all(texts))
    monkeypatch.setattr(byte_bpe, "CACHED_MATCHES", 1)
    monkeypatch.setattr(byte_bpe, "CHARS_AT_ONCE", 8)
    assert list(byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN).encode_all(texts)) == want
    monkeypatch.setattr(byte_bpe, "CACHED_MATCHES", 4)
    codec = byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN)
    assert list(codec.encode_all(texts * 2)) == want * 2 and codec.older


def test_decontamination_seeds_and_alignment():
    rng = np.random.default_rng(0)
    base = rng.integers(1, 1 << 60, 13).astype(np.uint64)
    for i in range(13):  # any two substitutions in 13 tokens leave a seed
        for j in range(i + 1, 13):
            other = base.copy()
            other[[i, j]] += np.uint64(1)
            assert any((decontaminate.seed_hashes(base, m) == decontaminate.seed_hashes(other, m)).any() for m in decontaminate.MASKS)
    for _ in range(200):
        equal = rng.random(rng.integers(1, 30)) < 0.7
        s, e = decontaminate.longest_alike(equal, 0.8)
        best = max((b - a for a in range(len(equal)) for b in range(a + 1, len(equal) + 1) if equal[a:b].sum() >= 0.8 * (b - a) - 1e-9), default=0)
        assert e - s == best


def test_seeds_cover_every_length():
    for n, k in ((13, 2), (15, 3), (20, 4), (25, 5)):  # with them 14, 16 to 19, 21 to 24; longer ones are cut into such
        patterns = (1 << np.array(list(itertools.combinations(range(n), k)))).sum(1)
        hit = np.zeros(len(patterns), bool)
        for mask in decontaminate.MASKS:
            for at in range(n - mask[-1]):
                hit |= patterns & (sum(1 << p for p in mask) << at) == 0
        assert hit.all(), n
    for n in range(1, 13):
        for differ in itertools.combinations(range(n), n // 5):
            assert any(not set(m) & set(differ) for m in decontaminate.short_masks(n)), (n, differ)


def test_decontamination_of_short_items_and_items_without_id(spark):
    words = [f"w{i}" for i in range(4000)]
    rng = random.Random(5)
    sizes = [*range(1, 21)]
    items = [rng.sample(words[i * 200 : i * 200 + 200], n) for i, n in enumerate(sizes)]
    docs, want = [], set()
    for i, item in enumerate(items):
        k = len(item) // 5
        for j in range(12):
            bad = set(rng.sample(range(len(item)), k))
            docs.append((i * 100 + j, "x y " + " ".join("other" if p in bad else w for p, w in enumerate(item)) + " z"))
            want.add((i * 100 + j, i if i % 2 else None))
    bad = {2, 5, 7}
    docs.append((9000, " ".join("other" if p in bad else w for p, w in enumerate(items[14]))))
    want.add((9000, None))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(i if i % 2 else None, " ".join(item)) for i, item in enumerate(items)], "item_id long, text string")
    found = decontaminate.overlaps(df, bench).collect()
    assert want == {(r.doc_id, r.item_id) for r in found}
    assert {r.n_tokens for r in found if r.doc_id // 100 == 6} == {7}
    assert decontaminate.without_leaks(df, bench).count() == 0
    spread = spark.createDataFrame([(1, "a b c a b c " * 50)], "doc_id long, text string")
    one = decontaminate.overlaps(spread, spark.createDataFrame([(7, "b c")], "item_id long, text string")).collect()
    assert [(r.item_id, r.doc_at, r.n_tokens) for r in one] == [(7, 1, 2)]


def plain_overlaps(docs, items, min_tokens=13, min_equal=0.8):
    """Every alignment of every document and item that could have enough equal tokens, its best stretch by trying all."""
    out = {}
    for item, text in items:
        b = decontaminate.tokens_of(text)
        need = min(min_tokens, len(b))
        for doc, other in docs:
            a = decontaminate.tokens_of(other)
            if not need or not len(a):
                continue
            alike = np.zeros(len(a) + len(b), int)  # by shift + len(b)
            for j, t in enumerate(b):
                alike[np.flatnonzero(a == t) - j + len(b)] += 1
            for shift in np.flatnonzero(alike >= 0.8 * need - 1e-9) - len(b):
                start, stop = max(0, shift), min(len(a), shift + len(b))
                equal = a[start:stop] == b[start - shift : stop - shift]
                sums = np.r_[0, np.cumsum(equal)]
                for n in range(len(equal), need - 1, -1):
                    good = np.flatnonzero(sums[n:] - sums[: len(sums) - n] >= min_equal * n - 1e-9)
                    if len(good):
                        s = good[0]
                        found = (n, int(sums[s + n] - sums[s]), -int(start + s), -int(start - shift + s))
                        out[doc, item] = max(out.get((doc, item), found), found)
                        break
    return {k: (n, e, -d, -i) for k, (n, e, d, i) in out.items()}


def test_decontamination_of_documents_against_brute_force(spark, data):
    """The registered query, and copies, ties and passages that several items share."""
    data = data.replace("sf0.001", "sf0.01")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): (r.n_tokens, r.n_equal, r.doc_at, r.item_at) for r in queries.op2_decontamination(spark, data).collect()}
    want = plain_overlaps(docs, items)
    assert got.keys() == want.keys() and len(want) > 5
    assert got == want
    shared = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    more = [(1, f"{shared} x {shared}"), (2, f"a b {shared}"), (3, f"a b {shared}"), (3, f"a b {shared}"), (4, shared.replace("five", "5").replace("ten", "10")), (5, "nothing")]
    bench = [(10, shared), (11, f"start {shared} end"), (12, shared)]
    df, bd = spark.createDataFrame(more, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_tokens, r.n_equal, r.doc_at, r.item_at) for r in decontaminate.overlaps(df, bd).collect()}
    assert got == plain_overlaps(more, bench) and len(got) == 12
    rows = spark.createDataFrame([(None, f"a b {shared}"), (None, "clean"), (7, "clean as well"), (7, f"b {shared}"), (8, None)], "doc_id long, text string")
    assert sorted((r.text or "") for r in decontaminate.without_leaks(rows, bd).collect()) == ["", "clean", "clean as well"]


def test_decontamination(spark, odd):
    words = [f"w{i}" for i in range(400)]
    rng = random.Random(3)
    items = [" ".join(rng.choice(words) for _ in range(n)) for n in (14, 30, 60, 8, 4)]
    swapped = items[2].split()
    for i in range(5, 60, 6):
        swapped[i] = "other"
    noise = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(100, noise(50) + " " + items[0] + " " + noise(9)), (101, items[1].upper() + "!"), (102, noise(5) + ", " + " ".join(swapped)), (103, noise(500)), (104, items[1][: len(items[1]) // 4]), (105, items[3])]
    df = odd.select("doc_id", "text").union(spark.createDataFrame(docs, "doc_id long, text string"))
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(9, None), (10, "")], "item_id long, text string")
    found = decontaminate.overlaps(df, bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(100, 0), (101, 1), (102, 2), (105, 3)}
    kept = decontaminate.without_leaks(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect() if (r.doc_id or 0) >= 100} == {103, 104}
    assert kept.count() == df.count() - 4
    assert decontaminate.overlaps(df.limit(0), bench).count() == 0 == decontaminate.overlaps(df, bench.limit(0)).count()


def test_decontamination_of_a_phrase_in_many_items_and_texts(spark, monkeypatch):
    """Each text is compared once for the phrase; those with a leak of another kind, or with none, are told all the same."""
    rng = random.Random(8)
    noise = lambda n: " ".join(f"n{rng.randrange(10**6)}" for _ in range(n))
    phrase, part = " ".join(f"p{i}" for i in range(14)), " ".join(f"q{i}" for i in range(9))
    items = [(i, f"{noise(6)} {phrase} {noise(6)} {part} {noise(5)}") for i in range(60)]
    lone = [f"l{i}" for i in range(13)]
    for m in decontaminate.MASKS:  # each hash of the lone passage is that of an item before its own, which has no more of it than the mask
        items += [(100 + len(items), " ".join([noise(4), *[w if i - at in m else noise(1) for i, w in enumerate(lone)], noise(4)])) for at in range(13 - m[-1])]
    items.append((999, f"{noise(4)} {' '.join(lone)} {noise(4)}"))
    docs = [(i, f"{noise(7)} {phrase} {noise(7)}") for i in range(300)]
    docs += [(1000 + i, f"{noise(30)} {part} {noise(3)}") for i in range(5)] + [(2000, f"{noise(9)} {' '.join(lone)} {noise(9)}")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows, measured = [], decontaminate._measured
    monkeypatch.setattr(decontaminate, "_measured", lambda c, *a: rows.append(c.count()) or measured(c, *a))
    assert sorted(r.doc_id for r in decontaminate.without_leaks(df, bench).collect()) == [1000 + i for i in range(5)]
    assert rows == [300 + 5 + 13, 5 * 60 + 13 + 1]  # all items only for the six that the first ones didn't reject
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(df, bench).collect()}
    assert got == plain_overlaps(docs, items).keys() and len(got) == 300 * 60 + 1


def test_url_rules_and_parts(spark):
    urls = ["https://WWW.Example.com/en/1?x", "http://example.com/en/", "http://a.net/es/x#y", "http://net/fr/", "http://com", "nothing", None, "x://B.com?/en/", "http://spam.org/casino"]
    df = spark.createDataFrame([(i, u, "<title>the casino win</title>", "h") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = by_id(url_filter.judge(df, queries.URL_RULES))
    want = [("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("example.com", "/en/", "example.com/en/", "block"), ("a.net", "/es/x", "net/es/", "block"), ("net", "/fr/", "net/fr/", "block")]
    assert [tuple(got[i])[1:5] for i in range(4)] == want
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(4, 8)] == [("com", "", None), ("", "", None), ("", "", None), ("b.com", "", None)]
    assert len(got) == len(urls) and {r.verdict for r in got.values()} <= {"allow", "block"}
    assert url_filter.judge(df.limit(0), queries.URL_RULES).count() == 0


def test_viterbi_and_bayes():
    counts = {"the": 50, "ring": 10, "casino": 5, "win": 8, "her": 5}
    candidates = [(i, w, n) for w, n in counts.items() for i in range(12) if "thecasinowin"[i:].startswith(w)]
    assert url_filter.viterbi("thecasinowin", candidates, 78) == ["the", "casino", "win"]
    assert "".join(url_filter.viterbi("zzq", [], 78)) == "zzq"
    model = url_filter.NaiveBayes({"casino": (0, 9), "news": (9, 0)}, (9, 9))
    assert model.score(["casino"]) > 0.8 > 0.2 > model.score(["news"]) and model.score(["other"]) == 0.5


def test_segmenter_against_brute_force(spark):
    """Names split by the joins as by trying every split; words of any length, and frequent short ones."""
    rng = random.Random(4)
    words = {"a": 900, "ab": 40, "the": 500, "her": 30, "there": 60, "in": 300, "ring": 20, "news": 9, "x" * 15: 3, "x" * 16: 3, "pneumonoultramicroscopic": 4, "pneumonoultramicrofilm": 2, "z": 1}
    names = ["".join(rng.choices(list(words), k=3)) for _ in range(40)] + ["pneumonoultramicroscopicnews", "pneumonoultramicrofil", "qqq", "x" * 33, "\u00e9news"]
    total = sum(words.values())
    unknown = math.log(1 / total) - 5.0

    def best(name):
        scores = [0.0] + [-math.inf] * len(name)
        for j in range(1, len(name) + 1):
            for i in range(j):
                p = math.log(words[name[i:j]] / total) if name[i:j] in words else unknown if j == i + 1 else None
                if p is not None:
                    scores[j] = max(scores[j], scores[i] + p, scores[i] + unknown if j == i + 1 else -math.inf)
        return scores[-1]

    counts = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r.name: r.words for r in url_filter.segmented(spark.createDataFrame([(n,) for n in names], "name string"), counts).collect()}
    assert set(got) == set(names)
    for name, split in got.items():
        assert "".join(split) == name
        score = sum(max(math.log(words[w] / total) if w in words else -math.inf, unknown if len(w) == 1 else -math.inf) for w in split)
        assert score == pytest.approx(best(name)), (name, split)


def test_url_examples_held_out():
    """Each example judged by a classifier that hasn't seen it."""
    groups = url_filter.example_words(url_filter.ALLOWED), url_filter.example_words(url_filter.BLOCKED)
    right = [0, 0]
    for k, group in enumerate(groups):
        for i, words in enumerate(group):
            rest = [g if j != k else group[:i] + group[i + 1 :] for j, g in enumerate(groups)]
            right[k] += (url_filter.fit(*rest).score(words) >= 0.5) == bool(k)
    assert right[0] >= 0.9 * len(groups[0]) and right[1] >= 0.9 * len(groups[1]), (right, list(map(len, groups)))


def test_url_method_on_pages(spark, data):
    out = queries.op4_url_filter(spark, data.replace("sf0.001", "sf0.01"))
    plain = [r for r in out.collect() if r.rule is None]
    bad = [r for r in plain if re.search("casino|bets|pills|spam|adult|ads-", r.host)]
    assert all((r.verdict == "block") == (r in bad) for r in plain) and len(plain) > len(bad)


def test_url_parts_and_rules_against_sql(spark, data):
    """Host, path and rule of every page, and of odd URLs, as DuckDB finds them."""
    odd = ["HTTP://A.Com/x", "a://b://c/d", "x://NET/es/?q", "x://net/es", "x://www.example.com/en/#f", "://?", "x://m.example.com/en/", "none", None, "x://\u0130.net/fr/"]
    rows = [(i, u, "") for i, u in enumerate(odd)] + [(3, odd[3], ""), (None, odd[0], "")]
    pages = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html").union(spark.createDataFrame([(None if i is None else i + 10**6, u, h) for i, u, h in rows], "page_id long, url string, html string"))
    got = sorted((-1 if r.page_id is None else r.page_id, r.host, r.path, r.rule or "") for r in url_filter.judge(pages, queries.URL_RULES).collect())
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", [(r.page_id, r.url) for r in pages.select("page_id", "url").collect()])
    con.execute("create table rules (rule varchar)")
    con.executemany("insert into rules values (?)", [(r,) for _, r in queries.URL_RULES])
    want = con.execute("""
with p as (select rowid as id, page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path from pages),
f as (select id, rule from p join rules on (host = split_part(rule, '/', 1) or ends_with(host, '.' || split_part(rule, '/', 1))) and starts_with(path, substr(rule, strpos(rule, '/'))) qualify row_number() over (partition by id order by length(rule) desc) = 1)
select coalesce(page_id, -1), host, path, coalesce(rule, '') from p left join f using (id) order by all""").fetchall()
    assert got == want


def test_licenses(spark):
    files = [
        ("/a/LICENSE", "This work is licensed under the GNU General Public License, version 3."),
        ("/a/b/x.py", "# Licensed under the Apache License, Version 2.0.\ncode\n" + "word " * 3000),
        ("/a/b/y.py", "plain text without a notice of any kind"),
        ("/a/b/LICENSE", "nothing to see"),
        ("/c/z.py", None),
        ("/c/z.py", ""),
        ("top.txt", "Released under the MIT License."),
        (None, "Released under the MIT License."),
        ("/a/q.txt", "the license is under this version of the public work in general"),
    ]
    df = spark.createDataFrame([(p, t, "x") for p, t in files], "path string, text string, license string")
    got = licenses.scan(df, df.path.endswith("LICENSE")).collect()
    assert len(got) == len(files)
    by = {r.path: (r.license, r.origin, r.from_dir) for r in got}
    assert by["/a/LICENSE"] == ("GPL-3.0", "header", None) and by["/a/b/x.py"] == ("Apache-2.0", "header", None)
    assert by["/a/b/y.py"] == ("GPL-3.0", "inherited", "/a") == by["/a/b/LICENSE"] and by["/a/q.txt"][1] == "inherited"
    assert by["/c/z.py"][1] == "none" and by["top.txt"][0] == "MIT" and by[None][1] == "none"
    assert licenses.scan(df.limit(0), df.path.endswith("LICENSE")).count() == 0


def test_licenses_of_documents_against_brute_force(spark, data, texts):
    notices = {"CC BY-NC 4.0": "CC-BY-NC-4.0", "Public License, version 3": "GPL-3.0", "Apache License, Version 2.0": "Apache-2.0", "MIT License": "MIT"}
    got = by_id(queries.op5_licenses(spark, data))
    for i, t in texts.items():
        want = next((v for k, v in notices.items() if k in (t or "")), None)
        assert (got[i].license if got[i].origin == "header" else None) == want


def wrapped(text, width, mark=""):
    return "\n".join(mark + line for line in textwrap.wrap(text, width))


def plain_scan(files, templates, threshold, min_share):
    """License, cosine, origin and from_dir of each file: every unit against every template, every parent looked through."""
    terms = lambda x: [w for w in re.split(r"[\W_]+", x.lower()) if w]
    flat = [(name, Counter(terms(x))) for name, notes in sorted(templates.items()) for x in notes]
    n = len(files)
    words = {w for _, tf in flat for w in tf}
    df = {w: sum(w in set(terms(x or "")) for _, x in files) for w in words}
    weight = lambda w: math.log((n + 1) / (df[w] + 1)) + 1 if w in words else math.log(n + 1) + 1
    comment = re.compile(r"^\s*(?:[#;%*]+|//+|/\*+|--+|<!--|\(\*|\.\.\s)")
    marks = re.compile(rf"{comment.pattern}|(?:\*+/|-->|\*\))\s*$")

    def best(text):
        raw = re.split(r"\r\n|\r|\n", text or "")
        lines = [marks.sub("", x) for x in raw]
        head = next((i for i, x in enumerate(raw) if not comment.match(x) and x.strip(" ")), len(raw))
        whole = "\n".join(lines)
        units = [whole, "\n".join(lines[:head]), *[p for p in re.split(r"\n\s*\n", whole) if "\n" in p], *lines, *[y for x in lines if re.search(r"[.;!?]\s", x) for y in re.split(r"(?<=[.;!?])\s+", x)]]
        found = []
        for unit in units:
            u = {w: c * weight(w) for w, c in Counter(terms(unit)).items()}
            for name, tf in flat:
                v = {w: c * weight(w) for w, c in tf.items()}
                dot = sum(u.get(w, 0) * x for w, x in v.items())
                if dot:
                    cosine = round(dot / math.sqrt(sum(x * x for x in u.values()) * sum(x * x for x in v.values())), 6)
                    if cosine >= threshold:
                        found.append((-cosine, name, -len(unit) / len(text)))
        return min(found, default=None)

    own = {p: best(x) for p, x in files}
    folder = lambda p: p.rpartition("/")[0]
    given = {}
    for p, b in own.items():
        if b and (re.search(licenses.NAMED, p) or -b[2] >= min_share):
            given[folder(p)] = min(given.get(folder(p), b), b, key=lambda x: x[:2])
    out = {}
    for p, b in own.items():
        at = folder(p)
        while not b and at not in given and at:
            at = folder(at)
        near = given.get(at) if not b else None
        out[p] = (b[1], -b[0], "header", None) if b else (near[1], -near[0], "inherited", at) if near else (None, None, "none", None)
    return out


def test_license_texts_headers_and_files(spark):
    """Licence texts wrapped and behind comment marks, their heads, and notices within prose, as in repositories."""
    texts_of = licenses.TEMPLATES
    prose = "Some words of a program that says nothing on its terms and goes on for a while with names like parser and buffer."
    longest = {k: max(v, key=len) for k, v in texts_of.items()}
    files = [(f"/lib/{k}/LICENSE", f"Copyright (c) 2020 Jane Doe\n\n{wrapped(x, 70)}\n") for k, x in longest.items()]
    files += [(f"/lib/{k}/src/main.c", f"/*\n{wrapped(x, 60, ' * ')}\n */\n\nint main(void) {{ return 0; }}\n{prose}\n" + (prose + chr(10)) * 30) for k, x in longest.items()]
    files += [(f"/lib/{k}/src/util.c", prose) for k in longest]
    files += [(f"/spdx/{i}.py", f"# SPDX-License-Identifier: {i}\n{prose}") for i in ("LGPL-3.0-only", "BSD-3-Clause", "MIT", "GPL-2.0-or-later")]
    files += [
        ("/doc/a.md", f"{prose} This software is licensed under the MIT License. {prose}"),
        ("/doc/GPL.txt", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\nEveryone is permitted to copy and distribute verbatim copies\nof this license document, but changing it is not allowed.\n\n" + wrapped(prose, 70)),
        ("/doc/deep/er/x.md", prose),
        ("/tie/one", "Released under the ISC License."),
        ("/tie/two", "Released under the zlib License."),
        ("/tie/three", prose + " x" * 50_000),
        ("COPYING", longest["Zlib"]),
        ("/empty", ""),
        ("/null", None),
    ]
    df = spark.createDataFrame([(p, x, "c") for p, x in files], "path string, text string, cosine string")
    got = {r.path: (r.license, r.cosine, r.origin, r.from_dir) for r in licenses.scan(df).collect()}
    want = plain_scan(files, texts_of, licenses.MIN_COSINE, licenses.MIN_SHARE)
    for p, w in want.items():
        assert got[p][0] == w[0] and got[p][2:] == w[2:] and (w[1] is None or got[p][1] == pytest.approx(w[1], abs=2e-6)), (p, got[p], w)
    for k in longest:
        assert got[f"/lib/{k}/LICENSE"][0] == got[f"/lib/{k}/src/main.c"][0] == k and got[f"/lib/{k}/src/util.c"][::3] == (k, f"/lib/{k}")
    assert [got[f"/spdx/{i}.py"][0] for i in ("LGPL-3.0-only", "BSD-3-Clause", "MIT", "GPL-2.0-or-later")] == ["LGPL-3.0", "BSD-3-Clause", "MIT", "GPL-2.0"]
    assert got["/doc/a.md"][0] == "MIT" and got["/doc/GPL.txt"][0] == "GPL-3.0"
    assert len(licenses.scan(df.unionByName(df)).collect()) == 2 * len(files)


def test_licenses_stay_in_the_jvm(spark):
    df = spark.createDataFrame([("/a", "Released under the MIT License.")], "path string, text string")
    plan = licenses.scan(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)


def png_with_filters(rows, kinds):
    """A plain encoder for all five row filters."""
    lines = bytearray()
    for y, kind in enumerate(kinds):
        lines.append(kind)
        for x in range(rows.shape[1]):
            a = int(rows[y, x - 1]) if x else 0
            b = int(rows[y - 1, x]) if y else 0
            c = int(rows[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            paeth = min((abs(p - v), k, v) for k, v in enumerate((a, b, c)))[2]
            lines.append((int(rows[y, x]) - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
    head = struct.pack(">IIBBBBB", rows.shape[1], len(kinds), 8, 0, 0, 0, 0)
    return media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"IDAT", zlib.compress(bytes(lines))) + media._chunk(b"IEND", b"")


def test_png_filters_and_damage():
    rows = np.random.default_rng(1).integers(0, 256, (40, 64), dtype=np.uint8)
    kinds = [random.Random(2).randrange(5) for _ in range(40)]
    assert (media.decode_png(png_with_filters(rows, kinds)) == rows).all()
    good = media.encode_png(rows)
    assert (media.decode_png(good) == rows).all()
    for bad in (good[:50], good[:-5], good[:60] + bytes([good[60] ^ 1]) + good[61:], b"", good[8:]):
        with pytest.raises(media.BadPng):
            media.decode_png(bad)


def test_media(spark, data, texts, odd):
    got = by_id(queries.op6_media(spark, data))
    for i, t in texts.items():
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    stored = media.store_as_png(odd)
    assert media.read_png(stored, keep=["doc_id"]).count() == odd.count()
    near = media.cosine_hash(np.arange(64 * 64, dtype=np.uint32).astype(np.uint8).reshape(64, 64))
    assert re.fullmatch("[0-9a-f]{16}", near)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c)
        total += v if i % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def base_spans(t):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, t or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


PII = ["a@b.com_x@d.org,é ü@z.co 1.2.3.4.5.6.7.8 999.1.1.1 00255.1.2.003", "+12 (34) 56-78.9 +1234 4111 1111 1111 1111", "@@a@b@c.d..e 4111-1111-1111-1111-4111", "é" * 50 + "x@y.z " * 700, "+1" + " " * 500 + "2", "5500 0000 0000 0004\t+49 30 1234567 x@@y.co."]


def test_pii(spark, data, texts, odd):
    extra = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(PII)], "doc_id long, text string")
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").union(extra)
    want = {**texts, **{10**6 + i: t for i, t in enumerate(PII)}}
    got = by_id(pii.report(docs))
    for i, t in want.items():
        spans = base_spans(t)
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert got[i].spans.startswith(text)
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]
    assert pii.report(odd).count() == odd.count() and pii.report(odd.limit(0)).count() == 0


def test_pii_context_and_redaction(spark):
    rows = [(0, "my ssn is 123-45-6789, bank DE89370400440532013000"), (1, "code 123-45-6789 and DE89370400440532013001"), (2, None), (3, "mail a@b.com or 1.2.3.4!")]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, hits string")
    assert [r.spans for r in pii.report(df).orderBy("doc_id").collect()] == ["iban:28:50,ssn:10:21", "", "", "email:5:12,ip:16:23"]
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert got == {0: "my ssn is <ssn>, bank <iban>", 1: rows[1][1], 2: None, 3: "mail <email> or <ip>!"} and pii.redact(df).columns == df.columns


def test_pii_context_is_taken_from_the_whole_text(spark):
    listed = "social security numbers: 123-45-6789, 234-56-7890, 345-67-8901"
    far = "ssn " + "x" * 600 + " 123-45-6789 " + "y" * 600 + " 234-56-7890 " + "é" * 30 + " tax"
    df = spark.createDataFrame([(0, listed), (1, "🎉" * 300 + " " + listed), (2, far)], "doc_id long, text string")
    at = [25, 38, 51]
    want = {0: at, 1: [301 + x for x in at], 2: [far.index("234-")]}
    got = {r.doc_id: r.spans for r in pii.report(df).collect()}
    assert got == {i: ",".join(f"ssn:{x}:{x + 11}" for x in xs) for i, xs in want.items()}
    assert [r.text for r in pii.redact(df).where("doc_id = 0").collect()] == ["social security numbers: <ssn>, <ssn>, <ssn>"]


def test_redact_masks_all_that_is_found(spark):
    many = " ".join(f"n{i} a{i}@b.com +33.1.42.68.53.{i % 90 + 10}" for i in range(700))
    rows = [(0, "+33.1.42.68.53.00"), (1, "é🎉 call +33.1.42.68.53.00, 1.2.3.4 or x@1.2.3.4!"), (2, many), (3, "nothing"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert got == {
        0: "<phone>",
        1: "é🎉 call <phone>, <ip> or <email>!",
        2: " ".join(f"n{i} <email> <phone>" for i in range(700)),
        3: "nothing",
        4: None,
        5: "",
    }
    for row in pii.find_spans(df).collect():  # outside the spans nothing changes
        text, inside = row.text or "", {i for s in row.spans for i in range(s.start, s.end)}
        left = "".join(c if i not in inside else "\x00" for i, c in enumerate(text))
        assert re.sub("<[a-z]+>", "\x00", got[row.doc_id] or "") == re.sub("\x00+", "\x00", left)


def test_toxic_folding_and_exceptions():
    assert toxicity.folded_words("Id10t іdіоt $tupid 12345 ＳＣＵＭ") == ["idiot", "idiot", "tupid", "12345", "scum"]
    lexicon = toxicity.Lexicon({" idiot ": 4.0, " trash ": 3.0, " lowei": 5.0}, ("trash can",), (-3.0, 6.0, 0.1, 0.1))
    assert lexicon.score("you іd10t") > 0.7 > lexicon.score("put it in the trash can") and lexicon.score("Loweiisch.") > 0.7
    assert lexicon.score(None) == lexicon.score("") == lexicon.score("idiotic is another word")


def test_toxic_exceptions_against_brute_force():
    """Exceptions that overlap or follow each other spare what starts inside one of them, in texts of any length."""
    lexicon = toxicity.Lexicon({" idi": 3.0, " scum ": 4.0, " trash ": 2.0, " fool ": 1.5}, ("trash can", "pond scum", "idiom of", "of fool"), (0.0, 1.0, 1.0, 1.0))
    choose = random.Random(5)
    for _ in range(500):
        words = choose.choices("idiom of fool trash can pond scum idiot x y".split(), k=choose.randint(1, 30))
        line = f" {' '.join(words)} "
        spared = [(m.start(), m.start() + len(p) + 1) for p in lexicon.exceptions for m in re.finditer(f"(?= {p} )", line)]
        total = sum(max(w for t, w in lexicon.weights.items() if line.startswith(t, at)) for at in range(len(line)) if any(line.startswith(t, at) for t in lexicon.weights) and not any(s <= at < e for s, e in spared))
        assert lexicon.features(" ".join(words)) == pytest.approx((float(total > 0), math.log1p(total), math.log1p(100 * total / len(words))))


def test_toxicity_held_out(spark, data):
    big = data.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    out = queries.op8_toxicity(spark, big).where("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r for r in out if r.toxic == 1], [r for r in out if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.7 * len(toxic) and sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in out)


def test_toxicity_edge_cases(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.judge(odd, none)
    assert got.count() == odd.count() and got.where("score is null or predicted = 1").count() == 0
    assert toxicity.without_toxic(odd, none).columns == odd.columns


def plain_fingerprint(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(fps):
    parent = {i: i for i in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}


def test_simhash_documents(spark, data, texts):
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = components_of(fps)
    got = by_id(queries.op9_simhash(spark, data))
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_simhash_links_of_any_three_bits(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(40)]
    fps = {}
    for c in centres:
        fps[len(fps)] = c
        chain = c
        for _ in range(6):
            for b in rng.sample(range(64), rng.choice([1, 2, 3])):
                chain ^= 1 << b
            fps[len(fps)] = chain
    for b in rng.sample(range(64), 4):  # four bits away: no link
        centres[0] ^= 1 << b
    fps[len(fps)] = centres[0]
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in set(fps.values())]
    roots = {r.node: r.root for r in simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()}
    want = components_of(fps)
    group = {}
    for i, v in fps.items():
        s = v - (1 << 64) if v >> 63 else v
        group.setdefault(want[i], set()).add(roots.get(s, s))
    assert all(len(g) == 1 for g in group.values()) and len(set.union(*group.values())) == len(group)


def test_near_duplicate_stage(spark, odd):
    rows = [(50, "a b c d e"), (51, "A b c d e"), (52, "something else entirely here"), (52, "something else entirely here"), (None, "only me and no id"), (None, "only me and no id"), (53, None), (54, "")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    kept = simhash.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect() if r.text) == [(-1, "only me and no id"), (50, "a b c d e"), (52, "something else entirely here")]
    assert [r.doc_id for r in kept.collect() if not r.text] == [53]
    assert simhash.keep_one_of_each(df.limit(0)).count() == 0


def test_one_id_with_unrelated_texts(spark):
    """Rows are told apart by id and text: unrelated texts under one id are both kept, near ones aren't."""
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(7, "the first text of seven"), (7, "another one, quite unlike it"), (8, "eight stands alone here"), (7, long), (7, long + " tail"), (9, long), (None, "no id at all"), (None, "No id at all"), (6, "eight stands alone here")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, first_id string")
    kept = simhash.keep_one_of_each(df)
    assert kept.columns == df.columns
    got = sorted((r.doc_id or -1, r.text) for r in kept.collect())
    assert got == sorted([(7, rows[0][1]), (7, rows[1][1]), (6, rows[2][1]), (7, long), (-1, "No id at all")])


def test_crowded_anchors(spark, monkeypatch):
    """Anchors with more fingerprints than a task takes give the same components."""
    rng = random.Random(11)
    centre = rng.getrandbits(64)
    fps = {}
    for _ in range(300):
        v = centre if rng.random() < 0.3 else rng.choice(list(fps.values()) or [centre])
        for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
            v ^= 1 << b
        fps[len(fps)] = v
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in set(fps.values())], "fp long")
    monkeypatch.setattr(simhash, "_AT_HOME", 4)
    monkeypatch.setattr(simhash, "_PART_HOME", 3)
    monkeypatch.setattr(simhash, "_PART_ALL", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        roots = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, group = components_of(fps), {}
    for i, v in fps.items():
        group.setdefault(want[i], set()).add(roots.get(signed(v), signed(v)))
    assert all(len(g) == 1 for g in group.values()) and len(set.union(*group.values())) == len(group)


def test_a_crowded_anchor_is_dealt_in_parts_of_bounded_size(spark, monkeypatch):
    """100,000 fingerprints of one anchor: no task holds more than a few thousand, and every pair meets."""
    monkeypatch.setattr(simhash, "_PART_HOME", 4000)
    monkeypatch.setattr(simhash, "_PART_ALL", 6000)
    crowded = spark.range(100_000).selectExpr("0L half", "7L anchor", "cast(id % 4 > 0 as long) guest", "xxhash64(id) fp")
    dealt = simhash._dealt(crowded)
    sizes = dealt.groupBy("home_part", "all_part").agg(common.F.count_if(common.F.col("guest") == 0).alias("home"), common.F.count_if(common.F.col("guest") == 1).alias("all")).collect()
    assert len(sizes) == 7 * 17 and max(r.home for r in sizes) < 5000 and max(r["all"] for r in sizes) < 7500
    assert sum(r.home for r in sizes) == 25_000 * 17 and sum(r["all"] for r in sizes) == 100_000 * 7
    nobody = crowded.where("guest = 1")
    assert simhash._dealt(nobody).count() == 0


def test_join_with_hot_keys(spark, monkeypatch):
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(i, i) for i in range(2, 30)] + [(None, 5)], "k long, v long")
    right = spark.createDataFrame([(i, i * 10) for i in range(1, 25)], "k long, w long")
    for keys in (1, 4, 1000):
        monkeypatch.setattr(common, "HOT_KEYS", keys)
        got = sorted(tuple(r) for r in common.join_hot(left, right, "k").collect())
        assert got == sorted((k, v, k * 10) for k, v in [(1, i) for i in range(50)] + [(i, i) for i in range(2, 25)])
    assert common.join_hot(left.limit(0), right, "k").count() == 0


def test_toxic_labels_of_equal_texts_and_learned_exceptions(spark):
    """Equal texts with both labels are toxic wherever they lie; phrases of clean texts around a term spare it; no number of terms is too many."""
    def used(i):
        return zlib.crc32(str(i).encode()) % 3 != 1

    ids = iter(i for i in range(10**6) if used(i))
    rows, labels = [], []
    for k in range(60):
        for toxic, text in ((1, f"you blockhead number {k} go away"), (0, f"a calm remark number {k} on things"), (1, f"same text {k}"), (0, f"same text {k}")):
            i = next(ids)
            rows.append((i, text))
            labels.append((i, 1, toxic))
    for k in range(200):
        i = next(ids)
        rows.append((i, f"one more calm remark, {k}"))
        labels.append((i, 1, 0))
    for k in range(3):
        i = next(ids)
        rows.append((i, f"the blockhead tool is in box {k}"))
        labels.append((i, 1, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    train = toxicity.training_rows(docs, marks).collect()
    assert len(train) == len({t for _, t in rows}) and {r.toxic for r in train if r.text.startswith("same")} == {1}
    lexicon = toxicity.learn(docs, marks)
    assert "blockhead tool" in lexicon.exceptions and "you blockhead" not in lexicon.exceptions
    assert lexicon.score("you blockhead") > lexicon.score("the blockhead tool") == lexicon.score("hello")
    word = lambda i: "k" + str(i).translate(str.maketrans("0123456789", "abcdefghij"))
    many = toxicity.Lexicon({f" {word(i)} ": 4.0 for i in range(60_000)})
    assert many.n_bytes() < common.BROADCAST_LIMIT and many.score(word(59_999)) > many.score("k")


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav>
<div class="cookie-notice">We use cookies on this site, and you can read about them here at length.</div>
<article><h2>Head&amp;line</h2><p>First   part with <b>bold</b> words&nbsp;and a long enough line of text to be dense.</p><script>var x = "</p>";</script>
<div class="ad">Buy now!</div><p>Second part<br>goes on &lt;here&gt;.<p>Short.</p></article>
<aside>Side text that is long enough to look like an article, but it stands at the side.</aside>
<section id="comments"><p>I am a reader and I have a lot to say about this article, at length, as readers do.</p></section><form>Send <input></form><footer>(c)</footer></body></html>"""


def test_html(spark, odd):
    want = "Head&line First part with bold words and a long enough line of text to be dense. Second part goes on <here>. Short."
    assert html_text.main_text(PAGE) == want
    loose = PAGE.replace("<article>", "<div>").replace("</article>", "</div>")
    assert html_text.main_text(loose) == want
    inner = '<main><div class="breadcrumbs">a</div><p>Teaser text</p><article data-hidden="no"><header class="entry-header"><h1>Head</h1></header><p>Body</p><article class="comment">me too</article></article></main>'
    assert html_text.main_text(inner) == "Head Body"
    assert html_text.main_text('<div class="site-header">x</div><main><p hidden>no</p><p>Yes</p>') == "Yes"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p><!-- x") == ""
    out = html_text.extract_text(odd, "text")
    assert out.count() == odd.count() and out.where("n_chars <> length(text)").count() == 0


def test_surge_and_dive():
    assert html_text.surge_and_dive([5, 0, 100, 120, 8, 0, 4]) == (2, 5)
    assert html_text.surge_and_dive([5, 0, 7, 3, 2, 120, 8, 0, 4]) == (2, 7)  # short lines that touch the surge from above
    assert html_text.surge_and_dive([5, 6, 0, 3]) == (0, 2)


def test_html_pages(spark, data):
    out = queries.op10_html_text(spark, data)
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    for r in out.collect():
        body = re.sub(r"(?s).*<article>(.*)</article>.*", r"\1", pages[r.page_id])
        import html

        plain = " ".join(html.unescape(re.sub(r"(?s)<(p|h1|br|/p|/h1|li|/li|ul|/ul|div|/div)\b[^>]*>", " ", body).replace("<b>", "").replace("</b>", "")).split())
        assert r.text == plain and r.n_chars == len(plain)


def test_html_pages_without_marks(spark, data):
    """The sums alone find the same texts: articles that aren't marked, and the surge and dive points as they are."""
    pages = [r.html for r in spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/pages.parquet").collect()]
    for page in pages:
        loose = re.sub(r"</?article\b[^>]*>", lambda m: "</div>" if m[0][1] == "/" else "<div>", page)
        lines = html_text.lines_of(loose)
        start, end = html_text.surge_and_dive(html_text.plain_sizes(lines))
        assert not any(mark for _, mark, _ in lines)
        assert " ".join(x[0] for x in lines[start:end] if x[0]) == html_text.main_text(loose) == html_text.main_text(page) != ""


def test_html_ties_and_odd_pages():
    same = "x" * 100
    assert html_text.surge_and_dive([100, 0, 0, 100]) == (0, 1) and html_text.surge_and_dive([3, 0, 3]) == (0, 1)
    assert html_text.main_text(f"<div>a {same}</div><nav>n</nav><nav>n</nav><p>b</p><nav>n</nav><div>b {same}</div>") == f"a {same}"
    long = " ".join(f"word{i}" for i in range(200_000))
    assert html_text.main_text(f"<p>{long}</p>") == long
    assert html_text.main_text("<p>" * 3000 + "deep") == "deep" and html_text.main_text("a < b <c") == "a < b"


def test_html_marks_bound_but_never_displace_a_denser_stretch():
    story = [f"Paragraph {i} of the story with quite enough words in it to be dense by itself, whatever stands beside." for i in range(8)]
    body = "".join(f"<p>{x}</p>" for x in story)
    card = "<article><p>A teaser card.</p></article>"
    for page in (f"<nav>x</nav><main>{body}</main><nav>y</nav>{card}", f"<div>{body}</div><nav>y</nav>{card}", f"{card}<nav>y</nav><div>{body}</div>"):
        assert html_text.main_text(page) == " ".join(story)
    for page in (f"<main>{card}{body}</main>", f"<div>{card}{body}</div>"):
        assert html_text.main_text(page) == " ".join(["A teaser card.", *story])
    # what is removed inside the article doesn't split it, a longer stretch outside doesn't displace it
    cut = f"<article>{body}<aside>x</aside>{body}</article><nav>y</nav><div>{body}{story[0]}</div>"
    assert html_text.main_text(cut) == " ".join(story * 2)
    two = f"<article>{body}</article><nav>y</nav><nav>y</nav><p>x</p><nav>y</nav><article>{body}</article>"
    assert html_text.main_text(two) == " ".join(story * 2)


def test_html_sections_named_by_their_topic():
    text = "A section of the article that goes on for long enough to be text of its own, not a widget of the page."
    page = "<article><p>Start.</p><section id='{}'><h2>Head</h2><p>{}</p></section><p>End.</p></article>"
    for name in ("discussion", "related-work", "search", "notices"):
        assert html_text.main_text(page.format(name, text)) == f"Start. Head {text} End."
        assert html_text.main_text(page.format(name, "short")) == "Start. End."
        assert html_text.main_text(page.format(name, f"<a href='/x'>{text}</a>")) == "Start. End."
    assert html_text.main_text(page.format("comments", text)) == html_text.main_text(page.format("related-comments", text)) == "Start. End."


def test_licenses_of_a_very_long_text(spark):
    """Megabytes of licence texts: every unit is found, in a time that grows with the text, in the JVM alone."""
    notes = "\n\n".join(t for texts in licenses.TEMPLATES.values() for t in texts)
    one = spark.createDataFrame([("/a", notes)], "path string, text string")
    twice = spark.createDataFrame([("/a", (notes + "\n\n") * 100)], "path string, text string")
    single = licenses.notices(one).where("kind = 'line'").groupBy("license").count().collect()
    many = {r.license: r["count"] for r in licenses.notices(twice).where("kind = 'line'").groupBy("license").count().collect()}
    assert many == {r.license: 100 * r["count"] for r in single}
