"""Statistics of tracks, their channels and whole collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _at_end(value: str) -> Column:
    """The value at the last kept point of a track, null included."""
    kept = F.when(~F.col("is_outlier"), F.struct("seg_no", "pt_no"))
    return F.max_by(F.struct(value), kept)[value]


def track_totals(enriched: DataFrame) -> DataFrame:
    """track_id, dist, time, pause, moving_time, started: of each track.

    Distance and time are those of the last point that isn't an outlier; the
    pause is summed over all segments.
    """
    out = enriched.groupBy("track_id").agg(
        F.coalesce(_at_end("dist"), F.lit(0.0)).alias("dist"),
        _at_end("t").alias("time"),
        F.sum("pause").alias("pause"),
        F.min_by(F.struct("ts"), F.struct("seg_no", "pt_no"))["ts"].alias("started"),
    )
    return out.withColumn("moving_time", F.col("time") - F.col("pause"))


def series_stats(graph: DataFrame) -> DataFrame:
    """Per track and channel: n, least, most, the mean weighted by distance, last s and t.

    The mean weighs each value by the step to it, and divides by the last
    distance; the first point of a segment weighs nothing.
    """
    order = Window.partitionBy("track_id", "channel", "seg_no").orderBy("g_no")
    step = F.coalesce(F.col("s") - F.lag("s").over(order), F.lit(0.0))
    place = F.struct("seg_no", "g_no")
    out = graph.withColumn("step", step).groupBy("track_id", "channel").agg(
        F.count("*").alias("n"),
        F.min("y").alias("y_min"),
        F.max("y").alias("y_max"),
        F.sum(F.col("y") * F.col("step")).alias("weighed"),
        F.min("s").alias("s_first"),
        F.max_by("s", place).alias("s_last"),
        F.max_by(F.struct("t"), place)["t"].alias("t_last"),
    )
    return out.withColumn("y_avg", F.try_divide("weighed", "s_last")).drop("weighed")


def climb(graph: DataFrame) -> DataFrame:
    """Ascent and descent of each track: positive and negative steps of the smoothed elevation within segments."""
    order = Window.partitionBy("track_id", "seg_no").orderBy("g_no")
    step = F.coalesce(F.col("y") - F.lag("y").over(order), F.lit(0.0))
    return graph.where("channel = 'elevation'").withColumn("step", step).groupBy("track_id").agg(
        F.sum(F.greatest("step", F.lit(0.0))).alias("ascent"),
        F.sum(F.greatest(-F.col("step"), F.lit(0.0))).alias("descent"),
        F.max("y").alias("ele_max"),
        F.min("y").alias("ele_min"),
    )


def speeds(graph: DataFrame, totals: DataFrame) -> DataFrame:
    """Maximum, average, moving average (m/s) and paces (s a km) of each track's speed series."""
    stats = series_stats(graph.where("channel = 'speed'"))
    out = stats.join(totals.select("track_id", "moving_time"), "track_id")
    average, moving = F.try_divide("s_last", "t_last"), F.try_divide("s_last", "moving_time")
    return out.select(
        "track_id",
        F.col("s_last").alias("dist"),
        F.col("y_max").alias("speed_max"),
        average.alias("speed_avg"),
        moving.alias("moving_avg"),
        F.try_divide(F.lit(3600.0), average * 3.6).alias("pace"),
        F.try_divide(F.lit(3600.0), moving * 3.6).alias("moving_pace"),
    )


def collection_averages(per_track: DataFrame, keys: list[str], value: str, distance: str = "s_last") -> DataFrame:
    """Averages over tracks, each weighed by its distance."""
    return per_track.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col(value) * F.col(distance)), F.sum(F.when(F.col(value).isNotNull(), F.col(distance)))).alias("avg"),
        F.count("*").alias("tracks"),
    )


def value_histogram(graph: DataFrame, channel: str = "ratio") -> DataFrame:
    """Distance by track and value; the first point of a segment adds none."""
    order = Window.partitionBy("track_id", "seg_no").orderBy("g_no")
    step = F.coalesce(F.col("s") - F.lag("s").over(order), F.lit(0.0))
    rows = graph.where(F.col("channel") == channel).withColumn("step", step)
    return rows.groupBy("track_id", "y").agg(F.sum("step").alias("ridden"))


def most_used(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """The value with the largest distance for each key; the smallest value of equal ones."""
    best = F.min_by(F.struct("y", "ridden"), F.struct(-F.col("ridden"), "y")).alias("b")
    return histogram.groupBy(*keys).agg(best).select(*keys, F.col("b.y").alias("top"), F.col("b.ridden").alias("ridden"))


def merged_histogram(histogram: DataFrame) -> DataFrame:
    return histogram.groupBy("y").agg(F.sum("ridden").alias("ridden"))


def collection_totals(totals: DataFrame) -> DataFrame:
    """Number of tracks, their distance, time and moving time, and the first and last date."""
    return totals.agg(
        F.count("*").alias("tracks"),
        F.sum("dist").alias("dist"),
        F.sum("time").alias("time"),
        F.sum("moving_time").alias("moving_time"),
        F.min("started").alias("first_date"),
        F.max("started").alias("last_date"),
    )


def elevation_by_kind(climbs: DataFrame) -> DataFrame:
    """Ascent, descent and extremes by kind (track, route) and over both, in one pass of grouping sets."""
    return (
        climbs.groupingSets([[F.col("kind")], []], "kind")
        .agg(
            F.sum("ascent").alias("ascent"),
            F.sum("descent").alias("descent"),
            F.max("ele_max").alias("ele_max"),
            F.min("ele_min").alias("ele_min"),
            F.grouping("kind").cast("int").alias("is_total"),
        )
    )


def time_quality(points: DataFrame, keys: list[str]) -> DataFrame:
    """Points without a time, and points not later than the one before them."""
    order = Window.partitionBy("track_id", "seg_no").orderBy("pt_no")
    skewed = F.coalesce(F.col("ts") <= F.lag("ts").over(order), F.lit(False))
    return points.withColumn("skewed", skewed).groupBy(*keys).agg(
        F.count_if("skewed").alias("skewed"), F.count_if(F.col("ts").isNull()).alias("missing"), F.count("*").alias("points")
    )


def report(totals: DataFrame, stats: DataFrame, climbs: DataFrame) -> DataFrame:
    """(metric, value) rows over a collection: totals, climb, and least, most and average of each channel."""
    base = totals.agg(
        F.count("*").cast("double").alias("tracks"), F.sum("dist").alias("distance"), F.sum("time").alias("time"), F.sum("moving_time").alias("moving_time")
    ).unpivot([], ["tracks", "distance", "time", "moving_time"], "metric", "value")
    climbed = climbs.agg(F.sum("ascent").alias("ascent"), F.sum("descent").alias("descent")).unpivot([], ["ascent", "descent"], "metric", "value")
    channels = stats.groupBy("channel").agg(
        F.min("y_min").alias("min"), F.max("y_max").alias("max"), F.try_divide(F.sum(F.col("y_avg") * F.col("s_last")), F.sum("s_last")).alias("avg")
    ).unpivot(["channel"], ["min", "max", "avg"], "part", "value")
    named = channels.select(F.concat_ws("_", "channel", "part").alias("metric"), "value")
    return base.unionByName(climbed).unionByName(named)
