"""Device messages: gear state, segments by stop events, laps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _order():
    return Window.partitionBy("file").orderBy("ord")


def with_ratio(messages: DataFrame) -> DataFrame:
    """Add ratio: front over rear teeth of the last gear change so far."""
    ratio = F.when((F.col("kind") == "event") & F.col("front").isNotNull() & (F.col("rear") > 0), F.col("front") / F.col("rear"))
    return messages.withColumn("change", ratio).withColumn("ratio", F.last("change", True).over(_order())).drop("change")


def segmented(messages: DataFrame) -> DataFrame:
    """Records with seg_no: a message that stops everything ends the segment after it."""
    stops = F.sum(F.coalesce(F.col("stop"), F.lit(False)).cast("int")).over(_order().rowsBetween(Window.unboundedPreceding, -1))
    return messages.withColumn("seg_no", F.coalesce(stops, F.lit(0))).where("kind = 'record'")


def laps(messages: DataFrame) -> DataFrame:
    """(file, lap_no, name, ts): laps by number, the last one named Finish; files with a single lap have none."""
    w = Window.partitionBy("file")
    out = messages.where("kind = 'lap'").withColumns({"lap_no": F.row_number().over(_order()), "n": F.count("*").over(w)})
    name = F.when(F.col("lap_no") == F.col("n"), "Finish").otherwise(F.concat(F.lit("Lap "), F.col("lap_no").cast("string")))
    return out.where("n > 1").select("file", "lap_no", name.alias("name"), "ts")
