"""Motion along tracks: distances, times, speeds, pauses and outliers of ordered points.

Input rows are trackpoints (track_id, seg_no, pt_no, ts, lon, lat, ...). The order
in a segment is pt_no. One shuffle on track_id serves every window here: segments
are windows inside their track's partition.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo


def _segment():
    return Window.partitionBy("track_id", "seg_no")


def _order():
    return _segment().orderBy("pt_no")


def _so_far():
    return _order().rowsBetween(Window.unboundedPreceding, 0)


def _track_before():
    return Window.partitionBy("track_id").orderBy("seg_no").rangeBetween(Window.unboundedPreceding, -1)

#: Points that one task of the windows over tracks gets on average: sorts of a task hold them all, so it is a number of rows, not of shuffled bytes.
TASK_POINTS = 1 << 18
#: Steps shorter than this many seconds have no speed of their own.
SHORTEST_STEP = 1e-3


@dataclass(frozen=True)
class TrackOptions:
    """Pauses are found by an automatic or the given speed (m/s) and interval (s)."""

    use_segments: bool = True
    detect_pauses: bool = True
    automatic_pause: bool = True
    pause_speed: float = 0.5
    pause_interval: float = 10.0
    eliminate_outliers: bool = True
    outlier_score: float = 5.0


def micros(ts: Column) -> Column:
    """Microseconds of a time with or without zone."""
    return F.unix_micros(ts.cast("timestamp"))


def flattened(points: DataFrame) -> DataFrame:
    """All segments of a track as one, numbered on."""
    order = Window.partitionBy("track_id").orderBy("seg_no", "pt_no")
    return points.withColumn("new", F.row_number().over(order)).withColumn("seg_no", F.lit(0)).withColumn("pt_no", F.col("new")).drop("new")


def steps(points: DataFrame) -> DataFrame:
    """Add ds and dt of the step to each point (0 at the first of a segment) and timed.

    Time that doesn't advance counts as a step of 0 s. ``timed`` holds if every
    point of the segment and of all segments before it has a time.
    """
    before = F.lag(F.struct("lon", "lat", "ts")).over(_order())
    moved = geo.distance(before["lon"], before["lat"], F.col("lon"), F.col("lat"))
    passed = F.when(F.col("ts") > before["ts"], (micros(F.col("ts")) - micros(before["ts"])) / 1e6).otherwise(0.0)
    first = F.row_number().over(_order()) == 1
    complete = F.min(F.col("ts").isNotNull()).over(Window.partitionBy("track_id").orderBy("seg_no").rangeBetween(Window.unboundedPreceding, 0))
    own = F.min(F.col("ts").isNotNull()).over(_segment())
    return points.withColumns(
        {"is_first": first, "ds": F.when(first, 0.0).otherwise(moved), "own_times": own, "timed": complete}
    ).withColumn("dt", F.when(F.col("own_times"), F.when(F.col("is_first"), 0.0).otherwise(passed)))


def raw_motion(points: DataFrame) -> DataFrame:
    """Add seg_dist, seg_time (within the segment), speed and acceleration of each point."""
    out = steps(points)
    moves = F.col("dt") >= SHORTEST_STEP
    own_speed = F.when(moves, F.col("ds") / F.col("dt"))
    speed = F.when(F.col("own_times"), F.coalesce(F.last(own_speed, True).over(_so_far()), F.lit(0.0)))
    out = out.withColumns({"seg_dist": F.sum("ds").over(_so_far()), "seg_time": F.sum("dt").over(_so_far()), "raw_speed": speed})
    change = F.when(moves, (F.col("raw_speed") - F.lag("raw_speed").over(_order())) / F.col("dt"))
    return out.withColumn("acceleration", F.when(F.col("own_times"), F.coalesce(F.last(change, True).over(_so_far()), F.lit(0.0))))


def pauses(moving: DataFrame, options: TrackOptions = TrackOptions()) -> DataFrame:
    """Add is_stop and pause, the seconds of a pause at its last point, else 0.

    A pause is a run of points at most as fast as the threshold, with the point
    before it, that lasts longer than the interval.
    """
    if not options.detect_pauses:
        return moving.withColumns({"is_stop": F.lit(False), "pause": F.lit(0.0)})
    if options.automatic_pause:
        limit = F.when(F.avg("raw_speed").over(_segment()) > 2.8, 0.40).otherwise(0.15)
    else:
        limit = F.lit(options.pause_speed)
    interval = 10.0 if options.automatic_pause else options.pause_interval
    out = moving.withColumn("pause_limit", limit)
    fast = F.coalesce(F.col("raw_speed") > F.col("pause_limit"), F.lit(True)) & ~F.col("is_first")
    # a fast point opens a run: it is the point before the slow ones that follow
    out = out.withColumn("run", F.sum(fast.cast("int")).over(_so_far()))
    run = Window.partitionBy("track_id", "seg_no", "run")
    lasts = F.max("seg_time").over(run) - F.min("seg_time").over(run)
    out = out.withColumn("lasts", lasts)
    is_stop = F.coalesce(F.col("own_times") & (F.col("lasts") > interval) & (F.count("*").over(run) > 1), F.lit(False))
    out = out.withColumn("is_stop", is_stop)
    at_end = F.lead("run").over(_order())
    ends = F.col("is_stop") & (at_end.isNull() | (at_end != F.col("run")))
    return out.withColumn("pause", F.when(ends, F.col("lasts")).otherwise(0.0)).drop("run", "lasts", "pause_limit")


def upper_median(df: DataFrame, value: str, out: str, keys: tuple[str, ...] = ("track_id", "seg_no")) -> DataFrame:
    """Add the upper median of a column within its keys: element n / 2 of the sorted values, from 0."""
    group = Window.partitionBy(*keys)
    place = F.row_number().over(group.orderBy(F.col(value).asc_nulls_last()))
    picked = F.when(F.col("\u0001place") == F.floor(F.count(value).over(group) / 2) + 1, F.col(value))
    return df.withColumn("\u0001place", place).withColumn("\u0001pick", picked).withColumn(out, F.max("\u0001pick").over(group)).drop("\u0001place", "\u0001pick")


def outliers(moving: DataFrame, options: TrackOptions = TrackOptions()) -> DataFrame:
    """Add is_outlier: modified z-score of the acceleration over the limit, and not a stop."""
    if not options.eliminate_outliers:
        return moving.withColumn("is_outlier", F.lit(False))
    out = upper_median(moving, "acceleration", "median")
    out = out.withColumn("deviation", F.abs(F.col("acceleration") - F.col("median")))
    return far_out(upper_median(out, "deviation", "mad"), options)


def far_out(out: DataFrame, options: TrackOptions) -> DataFrame:
    """Add is_outlier to points with the deviation of their acceleration and its median, mad."""
    score = F.when(F.col("mad") == 0, F.col("deviation") > 0).otherwise(0.6745 * F.col("deviation") / F.nullif(F.col("mad"), F.lit(0.0)) > options.outlier_score)
    far = F.coalesce(F.col("own_times") & score & ~F.col("is_stop"), F.lit(False))
    return out.withColumn("is_outlier", far)


def cleaned(flagged: DataFrame) -> DataFrame:
    """Add dist, t and speed without outliers, distances and times going on from segment to segment.

    Steps go from kept point to kept point; inside a pause the distance stands
    still and the speed is 0. A segment goes on from the last point of the one
    before it: from its clean distance, or its raw one if it is an outlier.
    """
    inner = F.coalesce(
        F.col("is_stop") & F.lag("is_stop").over(_order()) & F.lead("is_stop").over(_order()), F.lit(False)
    )
    out = flagged.withColumn("is_inner_stop", inner)
    kept = Window.partitionBy("track_id", "seg_no", "is_outlier").orderBy("pt_no")
    kept_so_far = kept.rowsBetween(Window.unboundedPreceding, 0)
    before = F.lag(F.struct("lon", "lat", "seg_time")).over(kept)
    step = geo.distance(before["lon"], before["lat"], F.col("lon"), F.col("lat"))
    first = before.isNull()
    ds = F.when(first, F.col("seg_dist")).when(F.col("is_inner_stop"), 0.0).otherwise(step)
    dt = F.col("seg_time") - before["seg_time"]
    own = (
        F.when(first, F.col("raw_speed")).when(F.col("is_inner_stop"), 0.0).when(dt >= SHORTEST_STEP, step / dt)
    )
    out = out.withColumns({"kept_ds": ds, "kept_speed": own})
    clean = F.when(F.col("is_outlier"), F.col("seg_dist")).otherwise(F.sum("kept_ds").over(kept_so_far))
    speed = F.when(F.col("is_outlier") | ~F.col("own_times"), F.col("raw_speed")).otherwise(F.last("kept_speed", True).over(kept_so_far))
    # segments without times keep their raw distances
    clean = F.when(F.col("own_times"), clean).otherwise(F.col("seg_dist"))
    out = out.withColumns({"clean_dist": clean, "clean_speed": speed})
    last = F.lead("pt_no").over(_order()).isNull()
    out = out.withColumns({"end_dist": F.when(last, F.col("clean_dist")), "end_time": F.when(last, F.col("seg_time"))})
    base = F.coalesce(F.sum("end_dist").over(_track_before()), F.lit(0.0))
    base_time = F.coalesce(F.sum("end_time").over(_track_before()), F.lit(0.0))
    return out.withColumns(
        {
            "dist": base + F.col("clean_dist"),
            "raw_dist": base + F.col("seg_dist"),
            "t": F.when(F.col("timed"), base_time + F.col("seg_time")),
            "v": F.when(F.col("timed"), F.col("clean_speed")),
        }
    ).drop("kept_ds", "kept_speed", "clean_dist", "clean_speed", "end_dist", "end_time")


def by_track(points: DataFrame, most: int = TASK_POINTS) -> DataFrame:
    """Tracks dealt to tasks that have about ``most`` points each, or fewer so that all cores work; a job counts the points.

    A given number of partitions isn't merged by the size of what was shuffled,
    of which every point takes a few bytes but kilobytes in the windows' sorts.
    """
    tasks = max(points.sparkSession.sparkContext.defaultParallelism, -(-points.count() // most))
    return points.repartition(tasks, "track_id")


def enrich_points(points: DataFrame, options: TrackOptions = TrackOptions()) -> DataFrame:
    """All derived columns of trackpoints; input columns stay."""
    points = points if options.use_segments else flattened(points)
    moving = raw_motion(by_track(points))
    return cleaned(outliers(pauses(moving, options), options))


def path(enriched: DataFrame) -> DataFrame:
    """The cleaned polyline: neither outliers nor the inside of pauses."""
    return enriched.where(~F.col("is_outlier") & ~F.col("is_inner_stop")).select("track_id", "seg_no", "pt_no", "lon", "lat", "dist")


def valid_tracks(points: DataFrame) -> DataFrame:
    """Tracks with a segment of two points or more."""
    return points.groupBy("track_id", "seg_no").count().where("count >= 2").select("track_id").distinct()


def without_repeats(points: DataFrame) -> DataFrame:
    """Points that differ in place from the point before them."""
    before = F.lag(F.struct("lon", "lat")).over(_order())
    return points.withColumn("same", F.coalesce((before["lon"] == F.col("lon")) & (before["lat"] == F.col("lat")), F.lit(False))).where("not same").drop("same")


def day_rollover(fixes: DataFrame, keys: list[str], order: str, time_of_day: str) -> DataFrame:
    """Add day_no: how often the time of day has gone backwards so far."""
    w = Window.partitionBy(*keys).orderBy(order)
    back = F.coalesce(F.col(time_of_day) < F.lag(time_of_day).over(w), F.lit(False)).cast("int")
    return fixes.withColumn("back", back).withColumn("day_no", F.sum("back").over(w)).drop("back")


def filled_forward(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Add the last known value so far."""
    return df.withColumn(out, F.last(value, True).over(Window.partitionBy(*keys).orderBy(order)))
