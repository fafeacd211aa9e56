"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, checks confirm them (Luhn for cards, mod-97
for IBANs, value ranges for addresses), and words near a span adjust its score.
Emails, IP addresses, cards and phone numbers that pass their checks are always
reported; the weaker kinds only where their score reaches the threshold.

The patterns carry possessive quantifiers and look-behinds so that a long run of
characters is read once: they find exactly the matches of the plain forms that
are given beside them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import quoted

#: Code points before and after a span in which context words count.
NEAR = 48
#: Spans of the weaker kinds need this score.
THRESHOLD = 0.6
#: Elements of an array whose running sums are taken at once.
_BLOCK = 256
#: Code points of a piece in which a text is read around its spans.
_CHUNK = 256

_LOCAL = "A-Za-z0-9._%+-"


@dataclass(frozen=True)
class Kind:
    """pattern: what proposes; must_contain: text that any match has; valid: check of a match; base: score before context; sure: always reported."""

    name: str
    pattern: str
    must_contain: str
    valid: Callable[[Column], Column]
    base: float
    context: str
    sure: bool = True


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _is_ip(hit: Column) -> Column:
    """Each part is at most 255; leading zeros don't count."""
    return ~F.regexp_replace(hit, r"(^|\.)0+(?=[0-9])", "$1").rlike(r"(?:^|\.)(?:[0-9]{4,}|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9])(?:\.|$)")


def _is_card(hit: Column) -> Column:
    digits = _digits(hit)
    return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)


def _is_phone(hit: Column) -> Column:
    return F.length(_digits(hit)).between(8, 15)


def _is_iban(hit: Column) -> Column:
    """15 to 34 characters whose rotated number is 1 modulo 97."""
    plain = F.regexp_replace(hit, " ", "")
    rotated = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    rest = F.aggregate(
        F.split(rotated, ""),
        F.lit(0),
        lambda acc, c: F.when(c == "", acc)
        .when(c.rlike("[0-9]"), (acc * 10 + c.try_cast("int")) % 97)
        .otherwise((acc * 100 + F.ascii(c) - 55) % 97),
    )
    return F.length(plain).between(15, 34) & (rest == 1)


def _is_ssn(hit: Column) -> Column:
    return ~hit.rlike("^(?:000|666|9)|-00-|-0000$")


KINDS = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda h: F.lit(True), 0.9, "mail|contact|write"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", _is_ip, 0.7, "ip|address|host|server"),
    # [0-9]([\x20-]?[0-9])+
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", _is_card, 0.8, "card|visa|credit|pay|karte|carte|tarjeta"),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", _is_phone, 0.7, "tel|phone|call|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", _is_iban, 0.7, "iban|account|bank|konto|compte|cuenta", False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", _is_ssn, 0.4, "ssn|social|security|insurance|tax", False),
)


def _hits(text: Column, kind: Kind) -> Column:
    """The matches of a kind's pattern, in order."""
    hits = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    if not kind.must_contain:
        return hits
    return F.when(F.contains(text, F.lit(kind.must_contain)), hits).otherwise(F.array().cast("array<string>"))


def _gaps(text: Column, hits: Column, kind: Kind) -> Column:
    """The pieces of text around the matches, one more than matches."""
    return F.when(F.size(hits) > 0, F.split(text, kind.pattern, -1)).otherwise(F.array().cast("array<string>"))


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each element of an int array those before it joined to 0; blocks keep the work near linear in long arrays."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")), lambda b: F.slice(values, b * _BLOCK + 1, _BLOCK))
    none = F.array().cast("array<int>")

    def within(total: Column, block: Column) -> Column:
        start = F.struct(total.alias("total"), none.alias("done"))
        return F.aggregate(block, start, lambda acc, n: F.struct(join(acc.total, n).alias("total"), F.concat(acc.done, F.array(acc.total)).alias("done")))

    def step(acc: Column, block: Column) -> Column:
        part = within(acc.total, block)
        return F.struct(part.total.alias("total"), F.concat(acc.done, F.array(part.done)).alias("done"))

    zero = F.struct(F.lit(0).alias("total"), F.array().cast("array<array<int>>").alias("done"))
    return F.flatten(F.aggregate(blocks, zero, step).done)


def _sums_before(lengths: Column) -> Column:
    """For each element the sum of those before it."""
    return _running(lengths, lambda a, b: a + b)


def _chunks(text: Column) -> Column:
    """The text in pieces of _CHUNK code points, so that a place in a long text is reached without reading up to it."""
    return F.when(F.length(text) <= _CHUNK, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0)))


def _cut(chunks: Column, start: Column, end: Column) -> Column:
    """Code points start to end (exclusive) of the chunked text; what lies behind the text is left out."""
    first = F.floor(start / _CHUNK).cast("int")
    n = F.greatest(F.floor((end - 1) / _CHUNK).cast("int") - first + 1, F.lit(0))
    return F.substr(F.array_join(F.slice(chunks, first + 1, n), ""), start - first * _CHUNK + 1, end - start)


def _score(kind: Kind, chunks: Column, start: Column, end: Column) -> Column:
    """Context words count in the text around the span, whatever other matches stand there."""
    near = F.lower(F.concat(_cut(chunks, F.greatest(start - NEAR, F.lit(0)), start), F.lit(" "), _cut(chunks, end, end + NEAR)))
    return F.lit(kind.base) + F.when(near.rlike(rf"\b(?:{kind.context})"), 0.25).otherwise(0.0)


def _spans(chunks: Column, gaps: Column, hits: Column, kind: Kind, threshold: float) -> Column:
    """array<struct<kind, start, end, score>> of confirmed matches; code points, end exclusive."""
    lengths = F.zip_with(gaps, hits, lambda g, h: F.length(g) + F.coalesce(F.length(h), F.lit(0)))
    parts = F.arrays_zip(gaps, _sums_before(lengths), hits).cast("array<struct<gap:string,sum:int,hit:string>>")
    valid = F.filter(parts, lambda p: p.hit.isNotNull() & kind.valid(p.hit))
    placed = F.transform(valid, lambda p: F.struct((p.sum + F.length(p.gap)).alias("start"), F.length(p.hit).alias("n")))

    def span(p: Column) -> Column:
        end = p.start + p.n
        score = F.least(_score(kind, chunks, p.start, end), F.lit(1.0))
        return F.struct(F.lit(kind.name).alias("kind"), p.start.alias("start"), end.alias("end"), score.alias("score"))

    found = F.transform(placed, span)
    if not kind.sure:
        found = F.filter(found, lambda s: s.score >= threshold)
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    return F.when(F.size(hits) > 0, found).otherwise(empty)


def find_spans(df: DataFrame, text: str = "text", threshold: float = THRESHOLD, column: str = "spans") -> DataFrame:
    """Append ``column``: array<struct<kind, start, end, score>>, kinds in the order of KINDS, each by start.

    Null and empty texts give an empty array. Matches of one kind never overlap;
    those of different kinds may. A match that fails its check is dropped
    without another try.
    """
    kept = [c for c in df.columns if c != column]
    whole = F.coalesce(F.col(quoted(text)), F.lit(""))
    out = df.select(*[F.col(quoted(c)) for c in kept], whole.alias("\u0001text"))
    whole, kept = F.col("\u0001text"), [F.col(quoted(c)) for c in kept]
    hits = {k: F.col(f"\u0001h{k.name}") for k in KINDS}
    gaps = {k: F.col(f"\u0001g{k.name}") for k in KINDS}
    out = out.select(*kept, whole, *[_hits(whole, k).alias(f"\u0001h{k.name}") for k in KINDS])
    out = out.select(*kept, _chunks(whole).alias("\u0001chunks"), *hits.values(), *[_gaps(whole, hits[k], k).alias(f"\u0001g{k.name}") for k in KINDS])
    spans = [_spans(F.col("\u0001chunks"), gaps[k], hits[k], k, threshold) for k in KINDS]
    return out.select(*kept, F.concat(*spans).alias(column))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def report(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, counts of the four base kinds, SHA-256 of the base spans and all spans as text."""
    found = find_spans(df.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("text")), "text", threshold).select("doc_id", "spans")
    sure = F.filter("spans", lambda s: s.kind.isin([k.name for k in KINDS if k.sure]))

    def count(kind: Kind) -> Column:
        return F.size(F.filter("spans", lambda s: s.kind == kind.name)).cast("long").alias(f"n_{kind.name}")

    counts = [count(k) for k in KINDS if k.sure]
    return found.select("doc_id", *counts, F.sha2(joined(sure), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _ends_before(spans: Column) -> Column:
    """For each span the furthest end of those before it, 0 for the first."""
    return _running(F.transform(spans, lambda s: s.end), F.greatest)


def redact(df: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The same rows and columns with every span of find_spans in ``text`` masked.

    All spans are found in the text as it is. Overlapping ones are masked as one
    stretch, by the kind of the span that starts first in angle brackets (of
    those that start together the longest, then the kind first in KINDS). Null
    texts stay null, texts without spans stay as they are.
    """
    whole, spans, before, runs, chunks = F.col(quoted(text)), *[F.col(f"\u0001{c}") for c in ("spans", "before", "runs", "chunks")]
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k.name), F.lit(i))])
    ordered = F.transform(spans, lambda s: F.struct(s.start.alias("start"), (-s.end).alias("minus"), rank[s.kind].alias("rank"), s.kind.alias("kind"), s.end.alias("end")))
    out = find_spans(df, text, threshold, "\u0001spans").withColumn("\u0001spans", F.array_sort(ordered))
    out = out.withColumn("\u0001before", F.when(F.size(spans) > 0, _ends_before(spans)).otherwise(F.array().cast("array<int>")))
    parts = F.arrays_zip(spans, before).cast("array<struct<span:struct<start:int,minus:int,rank:int,kind:string,end:int>,before:int>>")
    # a span that starts where nothing before it reaches opens a stretch; all before it end with the stretch before
    opens = F.filter(parts, lambda p: p.span.start >= p.before)
    out = out.withColumns({"\u0001runs": opens, "\u0001chunks": F.when(F.size(spans) > 0, _chunks(whole))})
    pieces = F.transform(runs, lambda r: F.concat(_cut(chunks, r.before, r.span.start), F.lit("<"), r.span.kind, F.lit(">")))
    rest = _cut(chunks, F.array_max(F.transform(spans, lambda s: s.end)), F.length(whole))
    masked = F.concat(F.array_join(pieces, ""), rest)
    out = out.withColumn(text, F.when(F.size(spans) > 0, masked).otherwise(whole))
    return out.select(*[F.col(quoted(c)) for c in df.columns])
