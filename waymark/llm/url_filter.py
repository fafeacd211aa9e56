"""URL filters: rules first, then a classifier of segmented host and path words.

A rule is a host and the beginning of a path; it fits its host and all
subdomains, and the longest fitting rule decides. Where none fits, the names in
the host are split into words by unigram Viterbi over word counts of the corpus,
and multinomial naive Bayes scores the words of host and path. The classifier is
fitted on a table of labelled URLs of any size, or else on short lists of example
names; words that no example has tell nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import checkpointed, join_hot, quoted

#: Parts of a name of up to so many letters meet the dictionary whole, longer words by their first so many letters.
PART = 16
#: Host keys are spread over so many salts where pages meet their hosts.
SALTS = 16
#: Labelled examples: names of sites and pages as words, made up for this purpose; none is a host of a known corpus.
BLOCKED = """
best-casino-bonus lucky-casino-slots casino-royal-games online-poker-bonus poker-bets-live sports-bets-today free-bets-tips betting-odds-win
slots-jackpot-win jackpot-lottery-bonus gamble-online-free roulette-casino-win bingo-bonus-slots
cheap-pills-online buy-viagra-cheap pills-without-prescription diet-pills-cheap cialis-viagra-shop pharmacy-pills-discount weight-loss-pills
adult-video-tube adult-dating-cams xxx-adult-movies porn-video-free sex-cams-live hot-escort-girls escort-dating-adult nude-cams-xxx
ads-server-click click-track-ads ads-banner-network track-pixel-ads popup-ads-tracker tracking-ads-click adserver-track-redirect
spam-links-farm link-farm-seo spam-mail-offer content-farm-clicks fake-followers-spam seo-spam-links
payday-loans-fast quick-loans-cash free-ringtones-download warez-crack-keygen replica-watches-cheap crypto-doubler-win
"""
ALLOWED = """
city-news-daily morning-news-report local-weather-news world-news-today science-daily-report history-of-art museum-of-history national-library-archive
open-source-code python-code-blog web-design-blog travel-blog-europe food-blog-recipes mountain-travel-guide hiking-trail-maps river-trail-guide
family-recipes-kitchen garden-plants-guide bird-watching-club football-club-news chess-club-online music-school-concert piano-lessons-home
university-research-lab school-of-medicine health-care-guide city-hospital-clinic doctor-advice-health math-lessons-school physics-research-journal
book-reviews-club poetry-and-prose film-festival-reviews theatre-tickets-city photo-gallery-nature animal-rescue-home dog-training-school
small-business-advice tax-law-guide public-transport-maps train-timetable-city used-car-reviews house-and-home furniture-shop-online bicycle-repair-shop
climate-change-facts space-telescope-images energy-policy-review farm-fresh-food organic-farm-shop track-and-field win-win-negotiation free-software-download
about-us contact-page help-forum-questions community-wiki-index privacy-policy terms-of-service product-manual-support download-page user-guide-online
"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NAMES = r"[^\p{L}\p{N}]+"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct<rule, verdict> of the longest fitting rule, else null. ``rules``: (verdict, "host/path") pairs, a short list."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + start))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def word_counts(*texts: DataFrame) -> DataFrame:
    """(word, n) over the lower-cased words of one-column frames, whole tables."""
    words = None
    for df in texts:
        one = df.select(F.explode(F.split(F.lower(F.coalesce(df[0], F.lit(""))), r"[^\p{L}]+")).alias("word"))
        words = one if words is None else words.unionByName(one)
    return words.where(F.length("word") > 0).groupBy("word").agg(F.count("*").alias("n"))


def viterbi(name: str, candidates: Sequence[tuple[int, str, float]], total: float) -> list[str]:
    """Most probable split of ``name``; ``candidates``: (start, word, count). Unknown letters cost more the longer they run."""
    at: dict[int, list[tuple[str, float]]] = {}
    for start, word, n in candidates:
        at.setdefault(start, []).append((word, math.log(n / total)))
    unknown = math.log(1 / total) - 5.0
    best: list[tuple[float, int, str]] = [(0.0, 0, "")] + [(-math.inf, 0, "")] * len(name)
    for i in range(len(name)):
        score = best[i][0]
        for word, log_p in [*at.get(i, ()), (name[i], unknown)]:
            j = i + len(word)
            if score + log_p > best[j][0]:
                best[j] = (score + log_p, i, word)
    words: list[str] = []
    i = len(name)
    while i:
        _, i, word = best[i]
        words.append(word)
    return words[::-1]


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) of each distinct name: its substrings meet the dictionary in a join, so neither side is gathered."""
    names = names.select("name").where(F.length("name") > 0).distinct()
    starts = names.select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("at"))
    lengths = F.sequence(F.lit(1), F.least(F.lit(PART), F.length("name") - F.col("at") + 1))
    parts = checkpointed(
        starts.select("name", (F.col("at") - 1).alias("start"), F.explode(F.transform(lengths, lambda n: F.substr(F.col("name"), F.col("at"), n))).alias("word"))
    )
    counts = counts.withColumn("n", F.col("n").cast("double"))
    total = counts.agg(F.sum("n")).first()[0] or 1
    short = join_hot(parts, counts.where(F.length("word") <= PART), "word").select("name", "start", "word", "n")
    # words longer than a part meet it by their beginning; all that begin alike stand in one row
    first = F.substr("word", F.lit(1), F.lit(PART))
    longer = counts.where(F.length("word") > PART).groupBy(first.alias("first")).agg(F.collect_list(F.struct("word", "n")).alias("words"))
    tails = parts.where(F.length("word") == PART).withColumnRenamed("word", "first").join(longer, "first")
    tails = tails.select("name", "start", F.explode("words").alias("w")).where(F.substr("name", F.col("start") + 1, F.length("w.word")) == F.col("w.word"))
    known = short.unionByName(tails.select("name", "start", "w.word", "w.n"))
    known = known.groupBy("name").agg(F.collect_list(F.struct("start", "word", "n")).alias("known"))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(name: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series(
            [viterbi(n, [] if k is None else [(int(x["start"]), x["word"], x["n"]) for x in k], total) for n, k in zip(name, known, strict=True)],
            dtype=object,
        )

    return names.join(known, "name", "left").select("name", split("name", "known").alias("words"))


def path_words(path: Column) -> Column:
    """Words of a path; a number is the word #."""
    return F.transform(
        F.filter(F.split(F.lower(path), _NAMES), lambda w: F.length(w) > 0), lambda w: F.when(w.rlike("^[0-9]+$"), "#").otherwise(w)
    )


def host_words(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, words) of each distinct host, in the order of its names."""
    names = hosts.select("host").distinct().select("host", F.posexplode(F.split("host", _NAMES)).alias("place", "name")).where("name <> ''")
    split = segmented(names, counts)
    return (
        names.join(split, "name")
        .groupBy("host")
        .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "words"))), lambda x: x.words)).alias("words"))
    )


class NaiveBayes:
    """Multinomial naive Bayes with Laplace smoothing; weights are log-odds of blocking, words without an example weigh nothing."""

    def __init__(self, counts: dict[str, tuple[int, int]], rows: tuple[int, int]):
        totals = [sum(c[k] for c in counts.values()) + len(counts) for k in (0, 1)]
        self.prior = math.log((rows[1] + 1) / (rows[0] + 1))
        self.weights = {w: math.log((b + 1) / totals[1]) - math.log((a + 1) / totals[0]) for w, (a, b) in counts.items()}

    def score(self, words: Sequence[str]) -> float:
        z = self.prior + sum(self.weights.get(w, 0.0) for w in words)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def example_words(names: str) -> list[list[str]]:
    """The words of each example of a list."""
    return [re.split("[^a-z]+", name) for name in names.split()]


def fit(allowed: Sequence[Sequence[str]], blocked: Sequence[Sequence[str]]) -> NaiveBayes:
    """From the words of labelled examples."""
    good, bad = (Counter(w for words in group for w in words) for group in (allowed, blocked))
    return NaiveBayes({w: (good[w], bad[w]) for w in good | bad}, (len(allowed), len(blocked)))


def with_words(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """Add the words of host and path; a host of very many rows is dealt to many tasks."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    known = hosts.select("host", "words", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    joined = salted.join(known, ["host", "salt"], "left").drop("salt")
    return joined.withColumn("words", F.concat(F.coalesce("words", F.array().cast("array<string>")), path_words(F.col("path"))))


def learned(examples: DataFrame) -> tuple[DataFrame, float]:
    """(word, weight) and prior of multinomial naive Bayes with Laplace smoothing, from (words, verdict); log-odds of blocking."""
    bad = F.col("verdict") == "block"
    rows = examples.agg(F.count_if(~bad), F.count_if(bad)).first()
    words = examples.select(F.explode("words").alias("word"), "verdict").groupBy("word").agg(F.count_if(~bad).alias("good"), F.count_if(bad).alias("bad"))
    words = checkpointed(words)
    n, good, blocked = words.agg(F.count("*"), F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    weight = F.log((F.col("bad") + 1) / (blocked + n)) - F.log((F.col("good") + 1) / (good + n))
    return checkpointed(words.select("word", weight.alias("weight"))), math.log((rows[1] + 1) / (rows[0] + 1))


def weighed_by(rows: DataFrame, weights: DataFrame, prior: float) -> DataFrame:
    """Add z, the prior and the weights of a row's words, by a join: the words may be any number."""
    numbered = checkpointed(rows.withColumn("\u0001row", F.monotonically_increasing_id()))
    words = checkpointed(numbered.select("\u0001row", F.explode("words").alias("word")))
    sums = join_hot(words, weights, "word").groupBy("\u0001row").agg(F.sum("weight").alias("z"))
    return numbered.join(sums, "\u0001row", "left").withColumn("z", F.lit(prior) + F.coalesce("z", F.lit(0.0))).drop("\u0001row")


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    page_id: str = "page_id",
    url: str = "url",
    html: str | None = "html",
    allowed: str = ALLOWED,
    blocked: str = BLOCKED,
    threshold: float = 0.5,
    labelled: DataFrame | None = None,
) -> DataFrame:
    """page_id, host, path, rule, verdict, words, score of each page.

    Word counts come from the paths and page titles of all pages. A null URL or
    one without :// has an empty host and path, fits no rule and is allowed, as
    are URLs whose words no example has. URLs of any length are judged whole.
    Repeated rows, and rows without an id, stay and are judged alike. A score of
    the threshold blocks. ``allowed`` and ``blocked`` are example names of
    words, short lists. ``labelled`` takes their place: rows (url, verdict) in any
    number, whose hosts are segmented as those of the pages and whose words are
    counted by Spark; verdicts but allow and block, and null ones, don't count.
    """
    title = F.regexp_extract(F.coalesce(F.col(quoted(html)), F.lit("")), "(?is)<title[^>]*>([^<]*)", 1) if html else F.lit("")
    parsed = pages.select(F.col(quoted(page_id)).alias("page_id"), F.col(quoted(url)).alias("url"), title.alias("title"))
    parsed = parsed.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "title")
    names = parsed.select("host")
    if labelled is None:
        model = fit(example_words(allowed), example_words(blocked))
        counts = checkpointed(word_counts(parsed.select("title"), parsed.select("path")))
        # words of the examples must be words to the segmenter, however rare in titles
        listed = counts.agg((F.coalesce(F.sum("n"), F.lit(0)) / 10_000 + 1).cast("long").alias("n"))
        listed = listed.select(F.explode(F.array(*map(F.lit, sorted(model.weights)))).alias("word"), "n")
        counts = checkpointed(counts.unionByName(listed).groupBy("word").agg(F.sum("n").alias("n")))
    else:
        known = labelled.where(F.col("verdict").isin("allow", "block")).select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "verdict")
        known = checkpointed(known)
        counts = checkpointed(word_counts(parsed.select("title"), parsed.select("path"), known.select("path")))
        names = names.union(known.select("host"))
    hosts = checkpointed(host_words(names, counts))

    joined = with_words(parsed.select("page_id", "host", "path"), hosts)
    if labelled is None:
        # a few hundred weights as a literal map: the score stays a column expression
        weight_of = F.create_map(*[x for w, v in sorted(model.weights.items()) for x in (F.lit(w), F.lit(v))])
        weighed = joined.withColumn("z", F.lit(model.prior) + F.aggregate("words", F.lit(0.0), lambda acc, w: acc + F.coalesce(weight_of[w], F.lit(0.0))))
    else:
        weighed = weighed_by(joined, *learned(with_words(known, hosts)))
    scored = weighed.withColumn("score", F.round(1.0 / (1.0 + F.exp(-F.col("z"))), 6)).withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    by_method = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), by_method).alias("verdict"), "words", "score")
