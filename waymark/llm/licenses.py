"""License scans, with DataFrame functions only.

A file is cut into units: the whole file, its header (the comment lines it begins
with), its paragraphs, lines and sentences. Each unit is compared with templates,
licence texts and notices, by the cosine of sparse TF-IDF vectors, and the best
one gives the file its licence. Files without a licence of their own take that of
the nearest ancestor directory with a licence file, found by joins on paths.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import BROADCAST_LIMIT, checkpointed, join_hot, quoted
from waymark.llm.license_texts import TEMPLATES

#: A unit needs this cosine to a template.
MIN_COSINE = 0.8
#: A file speaks for its directory if this share of its text is the notice, or if its name says so.
MIN_SHARE = 0.5
NAMED = r"(?i)(?:^|/)(?:un)?(?:licen[cs]e|copying|notice)(?:[.-][^/]*)?$"
#: Directory keys are spread over so many salts where files meet their directories.
SALTS = 16
_TERMS = r"[^\p{L}\p{N}]+"
#: What begins a comment line, and what may end one.
_COMMENT = r"^\s*(?:[#;%*]+|//+|/\*+|--+|<!--|\(\*|\.\.\s)"
_MARKS = rf"{_COMMENT}|(?:\*+/|-->|\*\))\s*$"


def _terms(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def terms_of(text: Column) -> Column:
    """Lower-cased words in order; the first or last may be empty."""
    return F.split(F.lower(text), _TERMS)


def _known(values: list) -> Column:
    return F.array(*map(F.lit, values))


def _constant(value: list | dict, kind: str) -> Column:
    """A literal of a large array or map: Spark folds it into one value, where one expression an entry would burden every step of planning."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def document_frequencies(files: DataFrame, words: list[str]) -> tuple[int, dict[str, int]]:
    """Number of files, and in how many of them each template word is; over all files."""
    hits = F.array_intersect(terms_of(F.coalesce("text", F.lit(""))), _known(words))
    counts = files.select(F.explode(hits).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return files.count(), {r["term"]: r["n"] for r in counts.collect()}  # as many rows as template words


def _distinctive(vectors: list[dict[str, float]], threshold: float) -> set[str]:
    """Words one of which any text of cosine ``threshold`` to a template holds.

    By Cauchy-Schwarz a text with none of the words outside C reaches at most
    the norm of the template inside C over its whole norm. C takes the words of
    least weight as long as this stays under the threshold.
    """
    kept: set[str] = set()
    for v in vectors:
        whole, inside = sum(x * x for x in v.values()), 0.0
        for word in sorted(v, key=lambda w: (v[w], w)):
            inside += v[word] ** 2
            if math.sqrt(inside / whole) >= threshold:
                kept.add(word)
    return kept


def _may_reach(terms: Column, vectors: list[dict[str, float]], threshold: float, idf: dict[str, float] | None = None, rare: float = 0.0) -> Column:
    """False only for texts whose cosine to every template stays under ``threshold``, by the same inequality.

    The template words in a text must hold threshold² of some template's squared
    norm. With ``idf``, they must also hold threshold² of the text's own, where
    every other word counts as one of weight ``rare``.
    """
    squares = [{w: x * x / sum(y * y for y in v.values()) for w, x in v.items()} for v in vectors]
    words = sorted({w for v in vectors for w in v})
    some = F.arrays_overlap(terms, _known(sorted(_distinctive(vectors, threshold))))
    hits = F.array_intersect(terms, _known(words))
    # one look-up a word gives its part of every template
    parts = _constant({w: [v.get(w, 0.0) for v in squares] for w in words}, "map<string,array<double>>")
    none = _constant([0.0] * len(squares), "array<double>")
    held = F.aggregate(hits, none, lambda acc, w: F.zip_with(acc, F.try_element_at(parts, w), lambda x, y: x + F.coalesce(y, F.lit(0.0))))
    enough = F.exists(held, lambda x: x >= threshold * threshold - 1e-9)
    if idf is None:
        return F.when(some, enough).otherwise(False)
    weight = _constant({w: idf[w] for w in words}, "map<string,double>")
    # template words in order, so that one pass counts each: a run of n weighs (n * weight)^2
    runs = F.array_sort(F.filter(terms, lambda w: w.isin(words)))
    start = F.struct(F.lit("").alias("word"), F.lit(0.0).alias("n"), F.lit(0.0).alias("sum"))

    def run(acc: Column) -> Column:
        return acc["sum"] + F.coalesce(F.pow(acc["n"] * F.try_element_at(weight, acc["word"]), F.lit(2.0)), F.lit(0.0))

    def count(acc: Column, w: Column) -> Column:
        more = F.struct(acc["word"].alias("word"), (acc["n"] + 1.0).alias("n"), acc["sum"].alias("sum"))
        return F.when(w == acc["word"], more).otherwise(F.struct(w.alias("word"), F.lit(1.0).alias("n"), run(acc).alias("sum")))

    squared = F.aggregate(runs, start, count, run)
    others = F.size(F.array_distinct(terms)) - F.size(hits) - F.array_contains(terms, "").cast("int")
    fits = squared * (1 - threshold * threshold) + 1e-6 >= threshold * threshold * rare * rare * others
    return F.when(some, F.when(enough, fits).otherwise(False)).otherwise(False)


def units_of(text: Column) -> Column:
    """array<struct<kind, nth, unit>> of a text: file, header, paragraphs, lines and sentences, without the marks of comments."""
    raw = F.split(text, r"\r\n|\r|\n")
    lines = F.transform(raw, lambda x: F.regexp_replace(x, _MARKS, ""))
    whole = F.array_join(lines, "\n")
    paragraphs = F.split(whole, r"\n\s*\n")
    # a header ends before the first line that is neither a comment nor blank
    code = F.array_position(F.transform(raw, lambda x: ~(x.rlike(_COMMENT) | (F.trim(x) == ""))), F.lit(True)).cast("int")
    header = F.array_join(F.slice(lines, F.lit(1), F.when(code > 0, code - 1).otherwise(F.size(lines))), "\n")
    sentences = F.flatten(F.transform(F.filter(lines, lambda x: x.rlike(r"[.;!?]\s")), lambda x: F.split(x, r"(?<=[.;!?])\s+")))

    def numbered(kind: str, parts: Column) -> Column:
        return F.transform(parts, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("nth"), x.alias("unit")))

    inner = F.filter(numbered("paragraph", paragraphs), lambda p: F.contains(p.unit, F.lit("\n")))  # of one line: the line
    return F.concat(numbered("file", F.array(whole)), numbered("header", F.array(header)), inner, numbered("line", lines), numbered("sentence", sentences))


def _small(df: DataFrame, n_bytes: int) -> DataFrame:
    """A table of measured size, broadcast where that is bounded."""
    return F.broadcast(df) if n_bytes <= BROADCAST_LIMIT else df


def notices(files: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, threshold: float = MIN_COSINE) -> DataFrame:
    """(path, kind, nth, license, cosine, share): units whose best template reaches ``threshold``; share is their part of the text.

    A unit's vector has TF-IDF weights; document frequencies of the template
    words are counted over all files, words of no template weigh as the rarest.
    Ties go to the licence that is first by name. Null and empty texts have no
    units that match; texts and lines of any length are compared whole; rows of
    one path are one file whose terms are added up.
    """
    templates = TEMPLATES if templates is None else templates
    flat = [(name, Counter(_terms(t))) for name, notes in sorted(templates.items()) for t in notes]
    words = sorted({w for _, tf in flat for w in tf})
    n, df = document_frequencies(files, words)
    rare = math.log(n + 1) + 1
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1 for w in words}
    vectors = [{w: c * idf[w] for w, c in tf.items()} for _, tf in flat]

    text = F.coalesce("text", F.lit(""))
    near = files.select("path", text.alias("text")).where(_may_reach(terms_of(F.col("text")), vectors, threshold))
    # the size is a column before units are cut: what is asked of the text behind that would copy it to each unit
    units = near.select("path", "text", F.length("text").alias("size")).select("path", "size", F.explode(units_of(F.col("text"))).alias("u"))
    units = units.select("path", "size", "u.kind", "u.nth", F.length("u.unit").alias("chars"), terms_of(F.col("u.unit")).alias("terms"))
    units = units.where(_may_reach(F.col("terms"), vectors, threshold, idf, rare))

    spark = files.sparkSession
    weights = _small(spark.createDataFrame([(w, float(x)) for w, x in idf.items()], "term string, idf double"), 100 * len(idf))
    entries = [(k, name, w, x / math.sqrt(sum(y * y for y in v.values()))) for k, ((name, _), v) in enumerate(zip(flat, vectors, strict=True)) for w, x in v.items()]
    entries = _small(spark.createDataFrame(entries, "template int, license string, term string, part double"), 120 * len(entries))

    key = ["path", "kind", "nth"]
    counted = units.select(*key, (F.col("chars") / F.col("size")).alias("share"), F.explode("terms").alias("term")).where("term <> ''")
    counted = counted.groupBy(*key, "term").agg(F.count("*").alias("tf"), F.max("share").alias("share"))
    weighed = checkpointed(counted.join(weights, "term", "left").withColumn("weight", F.col("tf") * F.coalesce("idf", F.lit(rare))))
    norms = weighed.groupBy(*key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"), F.max("share").alias("share"))
    dots = weighed.join(entries, "term").groupBy(*key, "template", "license").agg(F.sum(F.col("weight") * F.col("part")).alias("dot"))
    best = dots.join(norms, key).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("cosine") >= threshold)
    first = F.min_by(F.struct("license", "cosine", "share"), F.struct(-F.col("cosine"), "license")).alias("b")
    return best.groupBy(*key).agg(first).select(*key, "b.license", "b.cosine", "b.share")


def ancestors(path: Column) -> Column:
    """Directories above a path, nearest first: /a/b/c.txt gives /a/b, /a and the root, an empty string."""
    parts = F.split(path, "/")
    depth = F.size(parts)
    return F.transform(F.sequence(depth - 1, F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def scan(
    files: DataFrame,
    is_license_file: Column | None = None,
    path: str = "path",
    text: str = "text",
    templates: dict[str, tuple[str, ...]] | None = None,
    threshold: float = MIN_COSINE,
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """path, license, cosine, origin (header, inherited or none), from_dir of each file.

    A file's own licence is its best notice, of equally good ones the licence
    first by name. A file with a notice speaks for its directory if
    ``is_license_file`` says so, by default if it is named like one or the
    notice is ``min_share`` of its text; of several in one directory the best
    notice counts, then the licence first by name. Null texts have no notice;
    files with a null path have neither directory nor inheritance; repeated
    paths count as one file whose notices are pooled, and give a row each.
    """
    named = F.col(quoted(path)).rlike(NAMED) if is_license_file is None else is_license_file
    # a column called path in the input is replaced by the one named
    files = files.select(F.col(quoted(path)).alias("path"), F.col(quoted(text)).alias("text"), F.coalesce(named, F.lit(False)).alias("speaks"))
    found = notices(files.where("path is not null").select("path", "text"), templates, threshold)
    # of one notice that several units hold, the largest unit
    order = F.struct(-F.col("cosine"), "license", -F.col("share"))
    own = checkpointed(found.groupBy("path").agg(F.min_by(F.struct("license", "cosine", "share"), order).alias("own")))
    rows = files.select("path", "speaks")
    directory = F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0))), "/")
    holders = (
        rows.where("path is not null")
        .join(own, "path")
        .where(F.col("speaks") | (F.lit(is_license_file is None) & (F.col("own.share") >= min_share)))
        .groupBy(directory.alias("dir"))
        .agg(F.min_by("own", F.struct(-F.col("own.cosine"), F.col("own.license"))).alias("given"))
    )
    # directories are far fewer than files: each is resolved once, then files meet their own directory; all of them share the topmost ones
    dirs = rows.where("path is not null").select(directory.alias("dir")).distinct()
    above = checkpointed(dirs.select("dir", F.posexplode(ancestors(F.concat("dir", F.lit("/")))).alias("up", "ancestor")))
    resolved = (
        join_hot(above, checkpointed(holders.withColumnRenamed("dir", "ancestor")), "ancestor")
        .groupBy("dir")
        .agg(F.min_by(F.struct("ancestor", "given"), "up").alias("near"))
    )
    salted = rows.join(own, "path", "left").withColumns({"dir": directory, "salt": F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")})
    given = resolved.select("dir", "near", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    out = salted.join(given, ["dir", "salt"], "left")
    return out.select(
        "path",
        F.coalesce("own.license", "near.given.license").alias("license"),
        F.coalesce("own.cosine", "near.given.cosine").alias("cosine"),
        F.when(F.col("own").isNotNull(), "header").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("own").isNull(), F.col("near.ancestor")).alias("from_dir"),
    )
