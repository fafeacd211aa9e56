"""Reading by file name: every file of a path with the readers of its kind."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators.lineage import checkpointed
from waymark.sources import geojson, nmea, text, xml
from waymark.sources.common import ERRORS, Loaded, conformed, lines

Reader = Callable[..., Loaded]


@dataclass(frozen=True)
class Dialect:
    """A reader of one of several formats with an extension, and what tells its files: how the first line begins, or a line by its first letter."""

    read: Reader
    titles: tuple[str, ...] = ()
    letters: tuple[str, ...] = ()


_LETTERS = ("T", "W", "R")
#: Readers by extension, those of several dialects in the order in which they are tried.
READERS: dict[str, Sequence[Reader | Dialect]] = {
    "gpx": (xml.read_gpx,),
    "tcx": (xml.read_tcx,),
    "kml": (xml.read_kml,),
    "slf": (xml.read_slf,),
    "sml": (xml.read_sml,),
    "loc": (xml.read_loc,),
    "geojson": (geojson.read_geojson,),
    "json": (partial(geojson.read_geojson, glob="*.json"),),
    "csv": (text.read_csv,),
    "cup": (text.read_cup,),
    "txt": (text.read_dashcam,),
    "itn": (text.read_itn,),
    "igc": (text.read_igc,),
    "srt": (text.read_srt,),
    "nmea": (nmea.read_nmea,),
    "plt": (partial(text.read_ozi, kind="plt"),),
    "rte": (Dialect(partial(text.read_twonav, kind="rte"), letters=_LETTERS), Dialect(partial(text.read_ozi, kind="rte"), ("OziExplorer Route File",))),
    "wpt": (
        Dialect(text.read_gpsdump, ("$FormatGEO", "$FormatUTM")),
        Dialect(partial(text.read_twonav, kind="wpt"), letters=_LETTERS),
        Dialect(partial(text.read_ozi, kind="wpt"), ("OziExplorer Waypoint File",)),
    ),
    "trk": (partial(text.read_twonav, kind="trk"),),
}


def recognised(rows: DataFrame, dialects: Sequence[Dialect]) -> DataFrame:
    """(file, dialect): number of the dialect by a file's first line, else by letters, else the last."""
    first = F.trim(F.min_by(F.decode("line", "ISO-8859-1"), "line_no"))
    letters = F.max(F.left(F.trim(F.decode("line", "ISO-8859-1")), F.lit(1)).isin(*[x for d in dialects for x in d.letters]))
    known = rows.groupBy("file").agg(first.alias("title"), letters.alias("lettered"))
    dialect = F.lit(None).cast("int")
    for k, d in enumerate(dialects):
        for title in d.titles:
            dialect = F.when(F.startswith("title", F.lit(title)), k).otherwise(dialect)
    lettered = next((k for k, d in enumerate(dialects) if d.letters), len(dialects) - 1)
    return known.select("file", F.coalesce(dialect, F.when(F.col("lettered"), lettered), F.lit(len(dialects) - 1)).alias("dialect"))


def tried(readers: Sequence[Reader | Dialect], spark: SparkSession, path: str, kind: str) -> Loaded:
    """All files of an extension. Those of several dialects are read once, and the lines kept with the dialect of their file.

    A file that its reader refuses goes on to the dialects after it; what none
    reads is an error of the last.
    """
    if not isinstance(readers[0], Dialect):
        return readers[0](spark, path)
    raw = lines(spark, path, f"*.{kind}", None)
    rows = checkpointed(raw.join(recognised(raw, readers), "file"))
    parts, refused = [], None
    for k, d in enumerate(readers):
        mine = rows.where(F.col("dialect") == k)
        if refused is not None:
            mine = mine.unionByName(rows.where(F.col("dialect") < k).join(refused, "file", "left_semi"))
        got = d.read(spark, path, rows=mine.drop("dialect"))
        if k < len(readers) - 1:
            refused = checkpointed(got.errors.select("file").distinct())
            got = _each(got, lambda df, files: df.join(files, "file", "left_anti"), refused)
        parts.append(got)
    return reduce(Loaded.union, parts)


def _each(loaded: Loaded, change: Callable[[DataFrame, DataFrame], DataFrame], files: DataFrame) -> Loaded:
    return Loaded(**{f.name: change(getattr(loaded, f.name), files) for f in fields(loaded)})


def read(spark: SparkSession, path: str, kinds: list[str] | None = None) -> Loaded:
    """All files under a path, folders included; a file that can't be read is a row of errors, the others go on.

    ``kinds`` are the extensions to look for, by default those that are there;
    then files of unknown extension are errors too.
    """
    unknown = None
    if kinds is None:
        names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"))
        kind = F.lower(F.regexp_extract("file", "[.]([A-Za-z0-9]+)$", 1))
        kinds = sorted(r["kind"] for r in names.select(kind.alias("kind")).distinct().collect() if r["kind"] in READERS)  # a handful of extensions
        unknown = names.where(~kind.isin(list(READERS))).select("file", F.lit("unknown format").alias("msg"))
    parts = [tried(READERS[k], spark, path, k) for k in kinds]
    if unknown is not None:
        parts.append(Loaded(errors=conformed(spark, unknown, ERRORS)).completed(spark))
    return reduce(Loaded.union, parts) if parts else Loaded().completed(spark)


def with_errors_left_out(loaded: Loaded) -> DataFrame:
    """Trackpoints of files without errors."""
    return loaded.trackpoints.join(loaded.errors.select("file").distinct(), "file", "left_anti")
