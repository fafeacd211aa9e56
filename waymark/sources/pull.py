"""Elements of XML files by one streaming parse.

The lines of a file go through a pull parser in order, file by file, wherever
its splits were read. What comes out are rows of the elements asked for, each as
a small XML text for ``from_xml``, with the places of its ancestors. So a file is
read and parsed once for all the tables that a reader makes of it, and no task
ever holds more of it than one such element.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators.lineage import checkpointed
from waymark.sources.common import lines

#: Rows that are handed on at once.
_AT_ONCE = 1024
ERROR = "\u0001error"
SHAPE = "file string, tag string, row_no int, at array<int>, xml string"


class _Elements:
    """The elements of one file so far."""

    def __init__(self, file: str, tags: dict[str, tuple[str, ...]]):
        self.file, self.tags, self.out = file, tags, []
        self.path: list[tuple[str, int, Counter]] = [("", 0, Counter())]  # name, place among its like, children so far
        self.numbers: Counter = Counter()
        self.open, self.depth, self.text = None, 0, []
        self.parser = expat.ParserCreate()
        self.parser.buffer_text = True
        self.parser.StartElementHandler, self.parser.EndElementHandler, self.parser.CharacterDataHandler = self.start, self.end, self.data

    def start(self, name: str, attributes: dict[str, str]) -> None:
        name = name.rpartition(":")[2]
        children = self.path[-1][2]
        self.path.append((name, children[name], Counter()))
        children[name] += 1
        if self.open is None and name in self.tags:
            self.open, self.depth, self.text = name, 0, []
        if self.open is not None:
            self.depth += 1
            named = "".join(f" {k.rpartition(':')[2]}={quoteattr(v)}" for k, v in attributes.items() if not k.startswith("xmlns"))
            self.text.append(f"<{name}{named}>")

    def data(self, text: str) -> None:
        if self.open is not None:
            self.text.append(escape(text))

    def end(self, name: str) -> None:
        name, place, _ = self.path.pop()
        if self.open is None:
            return
        self.text.append(f"</{name}>")
        self.depth -= 1
        if self.depth == 0:
            nearest = {n: p for n, p, _ in self.path}
            at = [*(nearest.get(a, 0) for a in self.tags[name]), place]
            self.out.append((self.file, name, self.numbers[name], at, "".join(self.text)))
            self.numbers[name] += 1
            self.open = None

    def feed(self, line: bytes, last: bool = False) -> bool:
        """False once the file turns out not to be well-formed; then there is a row of tag ERROR with the line and the reason."""
        try:
            self.parser.Parse(line, last)
        except expat.ExpatError as wrong:
            self.out.append((self.file, ERROR, wrong.lineno, [], expat.errors.messages[wrong.code]))
            return False
        return True


def elements(spark: SparkSession, path: str, glob: str, tags: dict[str, tuple[str, ...]]) -> DataFrame:
    """(file, tag, row_no, at, xml) of each element of one of the tags, at any depth, those inside another left to it.

    ``row_no`` numbers the elements of a tag in a file; ``at`` has the place of
    each of the ancestors named for the tag among its like, and the element's own.
    Names come without their prefixes. Where a file isn't well-formed it ends with
    a row of tag ERROR, whose row_no is the line. The rows are kept, so that all
    that is made of them reads the files once.
    """
    ordered = lines(spark, path, glob, None).repartition("file").sortWithinPartitions("file", "line_no").select("file", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fits, out = None, False, []

        def rows(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal out
            if now is not None:
                out, now.out = out + now.out, []
            if len(out) > least:
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "tag", "row_no", "at", "xml"])
                out = []

        for batch in batches:
            for file, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or file != now.file:
                    if fits:
                        now.feed(b"", last=True)
                    yield from rows(_AT_ONCE)
                    now, fits = _Elements(file, tags), True
                fits = fits and now.feed(line + b"\n")
                if len(now.out) > _AT_ONCE:
                    yield from rows(0)
        if fits:
            now.feed(b"", last=True)
        yield from rows(0)

    return checkpointed(ordered.mapInArrow(run, SHAPE))


def of_tag(found: DataFrame, tag: str, schema: str) -> DataFrame:
    """Columns of the schema, file, row_no and at of the elements of one tag."""
    parsed = F.from_xml("xml", F.lit(schema), {"ignoreNamespace": "true", "mode": "PERMISSIVE"})
    # from a generator, as an element would be parsed again for each field named above it
    fields = found.where(F.col("tag") == tag).select("file", "row_no", "at", F.inline(F.array(parsed)))
    return fields.select(*[c for c in fields.columns if c not in ("file", "row_no", "at")], "file", "row_no", "at")


def broken(found: DataFrame) -> DataFrame:
    """Errors of files that aren't well-formed."""
    return found.where(F.col("tag") == ERROR).select("file", F.col("row_no").alias("line"), F.col("xml").alias("msg"))
