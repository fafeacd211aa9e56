"""What readers share: the lines of files, and the tables that a reader gives."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators.scan import Scan, of_part

TRACKPOINTS = (
    "file string, track_no int, seg_no int, pt_no int, ts timestamp, lon double, lat double, ele double, speed double, "
    "heart_rate double, temperature double, cadence double, power double, ratio double"
)
WAYPOINTS = (
    "file string, wpt_no int, lon double, lat double, ele double, ts timestamp, name string, description string, comment string, "
    "address string, phone string, symbol string, images array<string>, links array<struct<url:string,text:string>>"
)
ROUTEPOINTS = "file string, route_no int, pt_no int, lon double, lat double, ele double, name string"
AREAS = "file string, area_no int, name string, description string, rings array<array<array<struct<lon:double,lat:double>>>>, west double, south double, east double, north double"
ERRORS = "file string, line int, msg string"
_SCHEMAS = {"trackpoints": TRACKPOINTS, "routepoints": ROUTEPOINTS, "waypoints": WAYPOINTS, "areas": AREAS, "errors": ERRORS}


@dataclass
class Loaded:
    """Tables of one or many files; those that a format doesn't have are empty."""

    trackpoints: DataFrame | None = None
    routepoints: DataFrame | None = None
    waypoints: DataFrame | None = None
    areas: DataFrame | None = None
    errors: DataFrame | None = None

    def completed(self, spark: SparkSession) -> Loaded:
        return Loaded(**{k: conformed(spark, getattr(self, k), schema) for k, schema in _SCHEMAS.items()})

    def union(self, other: Loaded) -> Loaded:
        return Loaded(**{f.name: getattr(self, f.name).unionByName(getattr(other, f.name)) for f in fields(self)})


def conformed(spark: SparkSession, df: DataFrame | None, schema: str) -> DataFrame:
    """The columns of a schema, missing ones null, types cast."""
    empty = spark.createDataFrame([], schema)
    if df is None:
        return empty
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema.fields])


#: Lines of a file that is read in splits, each by a task of its own.
IN_FILE = Scan(("file",), "split", "line_no")


def _decoded(line: Column, encoding: str | None) -> Column:
    return line if encoding is None else F.decode(line, encoding)


def lines_of(spark: SparkSession, path: str, glob: str, encoding: str, rows: DataFrame | None) -> DataFrame:
    """``rows``, lines as bytes that have been read before, as texts; or the lines under a path."""
    return lines(spark, path, glob, encoding) if rows is None else rows.withColumn("line", _decoded(F.col("line"), encoding))


def lines(spark: SparkSession, path: str, glob: str = "*", encoding: str | None = "UTF-8") -> DataFrame:
    """(file, split, line_no, line) of each text file under a path, folders included; line numbers from 1.

    A file is read in splits, whose first bytes are their numbers. A line's number
    is its place in the split and the lines of all splits before it. Spark doesn't
    list files without a byte. ``encoding``: one in which a line break is a byte of
    its own; None gives lines as bytes.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    # rows of a split follow each other in one partition, so these numbers are without gaps within it
    read = reader.text(path).select(at.alias("at"), F.monotonically_increasing_id().alias("nth"), _decoded(F.col("value").cast("binary"), encoding).alias("line"))
    rows = read.select("at.file", "at.split", "nth", "line")
    placed = IN_FILE.carried(
        rows, {"n": F.count("*"), "first": F.min("nth")}, {"upto": F.coalesce(F.sum(of_part("n")).over(IN_FILE.before()), F.lit(0)), "first": of_part("first")}
    )
    return placed.select("file", "split", (F.col("upto") + F.col("nth") - F.col("first") + 1).cast("int").alias("line_no"), "line")


def in_file(order: str = "line_no") -> Window:
    return Window.partitionBy("file").orderBy(order)


def numbered(df: DataFrame, name: str, keys: list[str], order: str) -> DataFrame:
    """Add a number from 0 within keys."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)


def split_valid(df: DataFrame, message: str, line: str = "line_no") -> tuple[DataFrame, DataFrame]:
    """Rows with coordinates in range, and errors for the others."""
    good = geo.valid(F.col("lon"), F.col("lat"))
    return df.where(good), df.where(~good).select("file", F.col(line).alias("line"), F.lit(message).alias("msg"))


def number(text: Column) -> Column:
    return geo.no_nan(F.trim(text).try_cast("double"))


def first_error(errors: DataFrame) -> DataFrame:
    """One error a file, that of the first line."""
    return errors.groupBy("file").agg(F.min_by(F.struct("line", "msg"), "line").alias("e")).select("file", "e.*")
