"""Lookups along ordered series: as-of joins and interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import arcs


def next_sample(points: DataFrame, samples: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """Each point with the values of the first sample not earlier than it; nulls if there is none.

    Of samples at one time the last by ``nth`` counts.
    """
    best = samples.groupBy(*keys, time).agg(F.max_by(F.struct(*values), "nth").alias("sample"))
    rows = points.withColumn("is_point", F.lit(1)).unionByName(best.withColumn("is_point", F.lit(0)), allowMissingColumns=True)
    # backward in time with samples before points of their time, so that a running frame holds all that isn't earlier
    ahead = Window.partitionBy(*keys).orderBy(F.desc(time), "is_point").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("sample", F.last("sample", True).over(ahead)).where("is_point = 1")
    return found.select(*points.columns, *[F.col(f"sample.{v}").alias(v) for v in values])


def intervals(series: DataFrame, keys: list[str], x: str, y: list[str]) -> DataFrame:
    """(keys, seg_no, x0, x1, <y>0, <y>1): neighbouring points of each segment."""
    order = Window.partitionBy(*keys, "seg_no").orderBy("g_no")
    nxt = F.lead(F.struct(x, *y)).over(order)
    rows = series.withColumn("nxt", nxt).where("nxt is not null")
    return rows.select(*keys, "seg_no", F.col(x).alias("x0"), F.col(f"nxt.{x}").alias("x1"), *[c for v in y for c in (F.col(v).alias(f"{v}0"), F.col(f"nxt.{v}").alias(f"{v}1"))])


def _span_at(probes: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Probes with ``span``, the interval (x0, x1, ...) of their keys that holds ``at``, or null.

    Along (seg_no, x0) the intervals of a key mustn't go back, as distances and
    times don't. Then an interval can only be the one that was begun last, or one
    that touches ``at`` itself; so each end of an interval becomes a knot, and one
    running window over knots and probes finds both. Of intervals that touch
    ``at`` the one of the lower segment, then of the lower x0 counts.
    """
    fields = [c for c in spans.columns if c not in keys]
    # in the order of preference
    span = F.struct("seg_no", "x0", *[c for c in fields if c not in ("seg_no", "x0")])
    ends = F.array(F.struct(F.col("x0").alias("at"), F.lit(True).alias("begins")), F.struct(F.col("x1").alias("at"), F.lit(False).alias("begins")))
    knots = spans.select(*keys, span.alias("span"), F.explode(ends).alias("k")).select(*keys, "span", "k.at", "k.begins")
    onward = F.min(F.when(F.col("begins") & (F.col("span.x1") > F.col("at")), F.col("span")))
    knots = knots.groupBy(*keys, "at").agg(F.struct(F.col("at"), F.min("span").alias("touching"), onward.alias("onward")).alias("\u0001knot"))
    asked = probes.select(*keys, "at", F.struct(*probes.columns).alias("\u0001probe"))
    rows = knots.unionByName(asked, allowMissingColumns=True)
    upto = Window.partitionBy(*keys).orderBy("at", F.col("\u0001probe").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("\u0001knot", F.last("\u0001knot", True).over(upto)).where(F.col("\u0001probe").isNotNull())
    k = F.col("\u0001knot")
    hit = F.when(k["at"] == F.col("at"), k["touching"]).when(F.col("at") < k["onward"]["x1"], k["onward"])
    return found.select("\u0001probe.*", hit.alias("span"))


def interpolated(probes: DataFrame, series: DataFrame, keys: list[str], x: str, y: str, with_segment: bool = False) -> DataFrame:
    """(probe columns, y, seg_no on request): value of a series at each probe's ``at``, linear between points; null outside.

    ``x`` mustn't fall along a key's segments and points. Where an interval end
    is hit by two intervals, the one of lower segment, then lower x counts.
    """
    spans = intervals(series, keys, x, [y])
    spans = spans.select(*keys, "seg_no", "x0", F.col(f"{y}0").alias("y0"), "x1", F.col(f"{y}1").alias("y1"))
    found = _span_at(probes, spans, keys)
    h = F.col("span")
    part = F.when(h["x1"] > h["x0"], (F.col("at") - h["x0"]) / F.nullif(h["x1"] - h["x0"], F.lit(0.0))).otherwise(0.0)
    value = h["y0"] + part * (h["y1"] - h["y0"])
    return found.select(*probes.columns, value.alias(y), *[h["seg_no"].alias("seg_no")] * with_segment)


def _steps_of(path: DataFrame) -> DataFrame:
    """(track_id, seg_no, x0, x1, lon0, lat0, lon1, lat1, far and its arc) of the step to each point of a path.

    ``inside`` is false from a segment's end, or the start of the track, to the
    next segment's first point. What is costly and the same along a step is
    computed here, once a step.
    """
    before = F.lag(F.struct("seg_no", "dist", "lon", "lat")).over(Window.partitionBy("track_id").orderBy("seg_no", "pt_no"))
    steps = path.select("track_id", "seg_no", before.alias("b"), F.col("dist").alias("x1"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"))
    inside = F.coalesce(F.col("b.seg_no") == F.col("seg_no"), F.lit(False))
    steps = steps.select("*", inside.alias("inside"), F.coalesce("b.dist", F.lit(0.0)).alias("x0"), F.col("b.lon").alias("lon0"), F.col("b.lat").alias("lat0")).drop("b")
    return arcs.with_arc(steps, F.col("inside") & (F.col("x1") - F.col("x0") > geo.LONG_STEP))


def _placed(on_step: DataFrame) -> DataFrame:
    """Add h, struct<seg_no, x0, lon, lat> of the place ``at`` on a step: long steps are followed along the great circle, others straight."""
    length = F.col("x1") - F.col("x0")
    part = F.when(length > 0, (F.col("at") - F.col("x0")) / F.nullif(length, F.lit(0.0))).otherwise(0.0)
    return arcs.placed(on_step.withColumn("part", part)).withColumn("h", F.when(F.col("inside"), F.struct("seg_no", "x0", "lon", "lat")))


def position_at(probes: DataFrame, path: DataFrame) -> DataFrame:
    """(track_id, at, lon, lat): place on each path at a distance.

    Long steps are followed along the great circle, others straight; null
    outside the path. Where two steps meet, that of the lower segment, then of
    the lower distance counts.
    """
    found = _span_at(probes.select("track_id", "at"), _steps_of(path).where("inside"), ["track_id"])
    return _placed(found.select("track_id", "at", "span.*")).select("track_id", "at", "h.lon", "h.lat")


def distance_markers(path: DataFrame, every: float = 1000.0) -> DataFrame:
    """(track_id, at, lon, lat): a marker at each whole multiple of ``every`` metres of a path; null where the path has a gap.

    Each step finds its own markers, so nothing is joined.
    """
    first = F.greatest(F.ceil(F.col("x0") / every).cast("int"), F.lit(1))
    last = F.floor(F.col("x1") / every).cast("int")
    numbers = F.when(last >= first, F.sequence(first, last))
    marks = _steps_of(path).withColumn("k", F.explode(numbers)).withColumn("at", F.col("k") * every)
    return _placed(marks).groupBy("track_id", "at").agg(F.min("h").alias("h")).select("track_id", "at", "h.lon", "h.lat")


def wall_clock(at_time: Column, seg_start: Column, seg_first_time: Column) -> Column:
    """Clock time of an elapsed time in a segment."""
    return F.timestamp_micros(F.unix_micros(seg_start.cast("timestamp")) + F.round((at_time - seg_first_time) * 1e6).cast("long"))


def named_turnpoints(tasks: DataFrame, waypoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks (file, task_no, names) to their waypoints in order; and (file, task_no, name) of names that no waypoint has.

    A name means the first waypoint of that name in its file; ??? is skipped.
    """
    first = waypoints.groupBy("file", "name").agg(F.min_by(F.struct("lon", "lat"), "wpt_no").alias("w"))
    wanted = tasks.select("file", "task_no", F.posexplode("names").alias("place", "name")).where("name <> '???'")
    found = wanted.join(first, ["file", "name"], "left")
    good = found.where("w is not null").select("file", "task_no", "place", "name", "w.lon", "w.lat")
    return good, found.where("w is null").select("file", "task_no", "name")


def style_of(items: DataFrame, styles: DataFrame, style_maps: DataFrame, default: str) -> DataFrame:
    """Style of each item: that with its id, else that its style map points to, else the default."""
    direct = styles.select(F.col("style_id"), F.col("style").alias("direct"))
    mapped = style_maps.join(styles, style_maps.target == styles.style_id).select(style_maps.map_id.alias("style_id"), F.col("style").alias("mapped"))
    return items.join(direct, "style_id", "left").join(mapped, "style_id", "left").withColumn("style", F.coalesce("direct", "mapped", F.lit(default))).drop("direct", "mapped")
