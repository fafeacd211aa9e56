"""Motion along tracks of any length: the rules of ``points`` as a scan of two levels.

A segment is cut into ranges of points (``scan``): what a range needs of the
ranges before or after it is carried along one row a range, so a single track is
the work of many tasks. Only the rows of ranges, one for ``size`` points, are ever
together by segment or track. Medians come from ``selection``. Keys and numbers of points mustn't be null here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import points as plain
from waymark.operators import selection
from waymark.operators.lineage import checkpointed
from waymark.operators.points import SHORTEST_STEP, TrackOptions, micros
from waymark.operators.scan import Scan, of_part, plus

#: Points of a range, if points are numbered without gaps.
SIZE = 1 << 18
#: Points of a track from which on it is cut into ranges.
LONGEST = 1 << 22
_SEGMENT = ("track_id", "seg_no")
SCAN = Scan(_SEGMENT, "range_no", "pt_no")


def in_ranges(points: DataFrame, size: int = SIZE) -> DataFrame:
    """Add range_no; ranges go by the number of a point, so they are known without counting."""
    return points.withColumn("range_no", F.floor(F.col("pt_no") / size).cast("long"))


def _previous(value: Column, carry: str) -> Column:
    """Value of the point before, which may lie in the range before."""
    return F.when(F.col("opens"), F.col(carry)).otherwise(F.lag(value).over(SCAN.inside()))


def _of_segments(points: DataFrame, told: DataFrame) -> DataFrame:
    """Add what is told of segments, null where nothing is. It goes to the ranges first, so that points meet it by range."""
    parts = points.groupBy(*SCAN.keys).agg(F.count("*").alias("\u0001n")).drop("\u0001n")
    return points.join(parts.join(told, list(_SEGMENT), "left"), SCAN.keys)


def flattened(points: DataFrame) -> DataFrame:
    """All segments of a track as one, numbered on from 1; points come in ranges."""
    counts = points.groupBy(*SCAN.keys).agg(F.count("*").alias("n"))
    before = Window.partitionBy("track_id").orderBy("seg_no", "range_no").rowsBetween(Window.unboundedPreceding, -1)
    based = points.join(counts.select(*SCAN.keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("\u0002base")), SCAN.keys)
    number = (F.col("\u0002base") + F.row_number().over(SCAN.inside())).cast("int")
    return based.withColumn("pt", number).withColumns({"seg_no": F.lit(0), "pt_no": F.col("pt")}).drop("pt", "\u0002base", "range_no")


def raw_motion(points: DataFrame) -> DataFrame:
    """As ``points.raw_motion``, of points in ranges; adds mean_speed of the segment too."""
    last = F.max_by(F.struct("lon", "lat", "ts"), "pt_no")
    by_segment = Window.partitionBy(*_SEGMENT)
    upto = Window.partitionBy("track_id").orderBy("seg_no").rangeBetween(Window.unboundedPreceding, 0)
    out = SCAN.carried(
        points,
        {"last": last, "complete": F.min(F.col("ts").isNotNull())},
        {
            "before": F.lag(of_part("last")).over(SCAN.along()),
            "own_times": F.min(of_part("complete")).over(by_segment),
            "timed": F.min(of_part("complete")).over(upto),
        },
    )
    out = out.withColumn("opens", F.row_number().over(SCAN.inside()) == 1)
    out = out.withColumn("\u0002p", _previous(F.struct("lon", "lat", "ts"), "before"))
    p = F.col("\u0002p")
    passed = F.when(F.col("ts") > p["ts"], (micros(F.col("ts")) - micros(p["ts"])) / 1e6).otherwise(0.0)
    moved = geo.distance(p["lon"], p["lat"], F.col("lon"), F.col("lat"))
    out = out.withColumn("is_first", p.isNull()).withColumns(
        {"ds": F.when(F.col("is_first"), 0.0).otherwise(moved), "dt": F.when(F.col("own_times"), F.when(F.col("is_first"), 0.0).otherwise(passed))}
    )
    moves = F.col("dt") >= SHORTEST_STEP
    out = out.drop("before", "\u0002p").withColumn("own_speed", F.when(moves, F.col("ds") / F.col("dt")))

    sums = {"ds": F.sum("ds"), "dt": F.sum("dt"), "speed": SCAN.last(F.col("own_speed"))}
    base = {"ds0": F.sum(of_part("ds")).over(SCAN.before()), "dt0": F.sum(of_part("dt")).over(SCAN.before())}
    out = SCAN.carried(out, sums, {**base, "speed0": F.coalesce(F.last(of_part("speed"), True).over(SCAN.before()), F.lit(0.0))})
    speed = F.coalesce(F.last("own_speed", True).over(SCAN.so_far()), F.col("speed0"))
    out = out.withColumns(
        {
            "seg_dist": plus(F.col("ds0"), F.sum("ds").over(SCAN.so_far())),
            "seg_time": plus(F.col("dt0"), F.sum("dt").over(SCAN.so_far())),
            "raw_speed": F.when(F.col("own_times"), speed),
        }
    )
    slower = _previous(F.col("raw_speed"), "speed0")
    out = out.withColumn("change", F.when(moves & ~F.col("is_first"), (F.col("raw_speed") - slower) / F.col("dt")))
    mean = F.sum(of_part("sum")).over(by_segment) / F.sum(of_part("n")).over(by_segment)
    out = SCAN.carried(
        out,
        {"change": SCAN.last(F.col("change")), "sum": F.sum("raw_speed"), "n": F.count("raw_speed")},
        {"change0": F.coalesce(F.last(of_part("change"), True).over(SCAN.before()), F.lit(0.0)), "mean_speed": mean},
    )
    acceleration = F.coalesce(F.last("change", True).over(SCAN.so_far()), F.col("change0"))
    return out.withColumn("acceleration", F.when(F.col("own_times"), acceleration)).drop("own_speed", "change", "ds0", "dt0", "speed0", "change0")


def pauses(moving: DataFrame, options: TrackOptions = TrackOptions()) -> DataFrame:
    """As ``points.pauses``: runs of slow points may begin and end in other ranges.

    Forward goes the time at which the run that is open began; backward the time
    at which the run that is open at a range's end is over.
    """
    if not options.detect_pauses:
        return moving.withColumns({"is_stop": F.lit(False), "pause": F.lit(0.0)}).drop("mean_speed")
    limit = F.when(F.col("mean_speed") > 2.8, 0.40).otherwise(0.15) if options.automatic_pause else F.lit(options.pause_speed)
    interval = 10.0 if options.automatic_pause else options.pause_interval
    out = moving.withColumn("fast", F.coalesce(F.col("raw_speed") > limit, F.lit(True)) & ~F.col("is_first"))
    out = out.withColumn("nth", F.sum(F.col("fast").cast("long")).over(SCAN.so_far()))
    slow_head = F.max(F.when(F.col("nth") == 0, F.col("seg_time")))
    reduced = {
        "fast": F.max("nth"),
        "began": F.max(F.when(F.col("fast"), F.col("seg_time"))),
        "head": slow_head,
        "end": F.max("seg_time"),
        "first_fast": F.min_by("fast", "pt_no"),
    }
    # where the first range with a fast point lets an earlier run end: before that point, which may be in the range before
    over_at = F.when(of_part("fast") > 0, F.when(of_part("first_fast"), F.lag(of_part("end")).over(SCAN.along())).otherwise(of_part("head")))
    out = SCAN.carried(
        out,
        reduced,
        {"over_at": over_at},
        {
            "began0": F.coalesce(F.last(of_part("began"), True).over(SCAN.before()), F.lit(0.0)),
            "runs": of_part("fast"),
            "over0": F.coalesce(F.first(of_part("over_at"), True).over(SCAN.after()), F.last(of_part("end")).over(SCAN.whole())),
            "next_fast": F.lead(of_part("first_fast")).over(SCAN.along()),
        },
    )
    began = F.coalesce(F.last(F.when(F.col("fast"), F.col("seg_time")), True).over(SCAN.so_far()), F.col("began0"))
    run = Window.partitionBy(*SCAN.keys, "nth")
    over = F.when(F.col("nth") == F.col("runs"), F.col("over0")).otherwise(F.max("seg_time").over(run))
    out = out.withColumn("lasts", over - began)
    out = out.withColumn("is_stop", F.coalesce(F.col("own_times") & (F.col("lasts") > interval), F.lit(False)))
    in_range = F.lead("fast").over(SCAN.inside())
    at_end = F.coalesce(in_range, F.col("next_fast"), F.lit(True))
    return out.withColumn("pause", F.when(F.col("is_stop") & at_end, F.col("lasts")).otherwise(0.0)).drop(
        "fast", "nth", "began0", "runs", "next_fast", "over0", "lasts", "mean_speed"
    )


def outliers(moving: DataFrame, options: TrackOptions = TrackOptions()) -> DataFrame:
    """As ``points.outliers``; ``moving`` is read once a pass of the selection and should be checkpointed."""
    if not options.eliminate_outliers:
        return moving.withColumn("is_outlier", F.lit(False))
    keys = list(_SEGMENT)
    values = moving.select(*SCAN.keys, "acceleration")
    medians = checkpointed(selection.upper_medians(values, keys, "acceleration", "median", "range_no"))
    away = _of_segments(values, medians).withColumn("deviation", F.abs(F.col("acceleration") - F.col("median")))
    mads = selection.upper_medians(away, keys, "deviation", "mad", "range_no")
    both = checkpointed(medians.join(mads, keys))
    out = _of_segments(moving, both).withColumn("deviation", F.abs(F.col("acceleration") - F.col("median")))
    return plain.far_out(out, options)


def cleaned(flagged: DataFrame) -> DataFrame:
    """As ``points.cleaned``: the last kept point, distance and speed are carried from range to range, ends from segment to segment."""
    kept = ~F.col("is_outlier")
    place = F.when(kept, F.struct("lon", "lat", "seg_time"))
    out = SCAN.carried(
        flagged,
        {"kept": SCAN.last(place), "first_stop": F.min_by("is_stop", "pt_no"), "last_stop": F.max_by("is_stop", "pt_no")},
        {
            "kept0": F.last(of_part("kept"), True).over(SCAN.before()),
            "stop0": F.lag(of_part("last_stop")).over(SCAN.along()),
            "stop1": F.lead(of_part("first_stop")).over(SCAN.along()),
        },
    )
    ahead = F.coalesce(F.lead("is_stop").over(SCAN.inside()), F.col("stop1"))
    inner = F.coalesce(F.col("is_stop") & _previous(F.col("is_stop"), "stop0") & ahead, F.lit(False))
    earlier = F.coalesce(F.last(place, True).over(SCAN.inside().rowsBetween(Window.unboundedPreceding, -1)), F.col("kept0"))
    out = out.withColumns({"is_inner_stop": inner, "\u0002b": earlier})
    b = F.col("\u0002b")
    step = geo.distance(b["lon"], b["lat"], F.col("lon"), F.col("lat"))
    dt = F.col("seg_time") - b["seg_time"]
    ds = F.when(b.isNull(), F.col("seg_dist")).when(F.col("is_inner_stop"), 0.0).otherwise(step)
    own = F.when(b.isNull(), F.col("raw_speed")).when(F.col("is_inner_stop"), 0.0).when(dt >= SHORTEST_STEP, step / dt)
    out = out.withColumns({"kept_ds": F.when(kept, ds), "kept_speed": F.when(kept, own)}).drop("\u0002b", "kept0", "stop0", "stop1")
    out = SCAN.carried(
        out,
        {"sum": F.sum("kept_ds"), "speed": SCAN.last(F.col("kept_speed"))},
        {"sum0": F.sum(of_part("sum")).over(SCAN.before()), "v0": F.last(of_part("speed"), True).over(SCAN.before())},
    )
    raw = F.col("is_outlier") | ~F.col("own_times")
    clean = F.when(raw, F.col("seg_dist")).otherwise(plus(F.col("sum0"), F.sum("kept_ds").over(SCAN.so_far())))
    speed = F.when(raw, F.col("raw_speed")).otherwise(F.coalesce(F.last("kept_speed", True).over(SCAN.so_far()), F.col("v0")))
    out = out.withColumns({"clean_dist": clean, "clean_speed": speed}).drop("kept_ds", "kept_speed", "sum0", "v0")
    ends = out.groupBy(*_SEGMENT).agg(F.max_by(F.struct("clean_dist", "seg_time"), "pt_no").alias("end"))
    segments_before = Window.partitionBy("track_id").orderBy("seg_no").rowsBetween(Window.unboundedPreceding, -1)
    bases = {"base": "end.clean_dist", "base_time": "end.seg_time"}
    ends = ends.select(*_SEGMENT, *[F.coalesce(F.sum(c).over(segments_before), F.lit(0.0)).alias(k) for k, c in bases.items()])
    return (
        _of_segments(out, ends)
        .withColumns(
            {
                "dist": F.col("base") + F.col("clean_dist"),
                "raw_dist": F.col("base") + F.col("seg_dist"),
                "t": F.when(F.col("timed"), F.col("base_time") + F.col("seg_time")),
                "v": F.when(F.col("timed"), F.col("clean_speed")),
            }
        )
        .drop("clean_dist", "clean_speed", "base", "base_time")
    )


def enrich_ranges(points: DataFrame, options: TrackOptions = TrackOptions(), size: int = SIZE) -> DataFrame:
    """``points.enrich_points``, every segment in ranges of ``size`` point numbers."""
    wanted = points.columns
    ranged = in_ranges(points, size)
    if not options.use_segments:
        ranged = in_ranges(flattened(ranged), size)
    # medians read the points nine times, so they go on from a written table
    moving = checkpointed(pauses(raw_motion(ranged.repartition(*SCAN.keys)), options))
    out = cleaned(outliers(moving, options))
    return out.select(*wanted, *[c for c in out.columns if c not in wanted and c not in ("range_no", "opens")])


def enrich_points(points: DataFrame, options: TrackOptions = TrackOptions(), longest: int = LONGEST, size: int = SIZE) -> DataFrame:
    """``points.enrich_points`` for tables with extreme tracks: those of more than ``longest`` points go in ranges.

    Tracks are counted first. The long ones are few (a table of n points has at
    most n / longest), so their ids are broadcast. Tracks with a null key or
    point number stay with the windows.
    """
    known = F.col("track_id").isNotNull() & F.col("seg_no").isNotNull() & F.col("pt_no").isNotNull()
    sizes = points.groupBy("track_id").agg(F.count("*").alias("n"), F.min(known).alias("known"))
    long = checkpointed(sizes.where((F.col("n") > longest) & F.col("known")).select("track_id"))
    if long.isEmpty():
        return plain.enrich_points(points, options)
    few = F.broadcast(long)
    usual = plain.enrich_points(points.join(few, "track_id", "left_anti").select(*points.columns), options)
    extreme = enrich_ranges(points.join(few, "track_id", "left_semi").select(*points.columns), options, size)
    return usual.unionByName(extreme.select(*usual.columns))
