"""Queries over tracks: motion, channels and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import channels, points, ranges, routes, sessions, stats, thinning
from waymark.plans import checks
from waymark.plans.catalog import Register
from waymark.plans.fixtures import fixture, plain

register = Register()
_KEYS = ["track_id", "seg_no", "pt_no"]


def r(column: str, digits: int = 3, name: str | None = None):
    return F.round(F.col(column), digits).alias(name or column.split(".")[-1])


def tracks(spark: SparkSession, d: str) -> DataFrame:
    return points.enrich_points(fixture(spark, d, "trackpoints"))


def graph(spark: SparkSession, d: str, names: list[str] | None = None) -> DataFrame:
    return channels.graph(tracks(spark, d), names)


_E = checks.enriched()


def _point_query(name: str, columns: dict[str, int | None], source: str = "trackpoints") -> None:
    """A query that shows derived columns of every point, rounded where they are doubles."""
    sql = ", ".join(c if n is None else f"round({c}, {n}) AS {c}" for c, n in columns.items())

    def run(spark: SparkSession, d: str) -> DataFrame:
        out = points.enrich_points(fixture(spark, d, source))
        return out.select(*_KEYS, *[F.col(c) if n is None else r(c, n) for c, n in columns.items()])

    register(name, f"{checks.enriched(source)} SELECT track_id, seg_no, pt_no, {sql} FROM e")(run)


_point_query("w01_step", {"ds": 3})
_point_query("w02_cumulative_distance", {"raw_dist": 2, "seg_dist": 2})
_point_query("w03_elapsed", {"dt": 6, "t": 6})
_point_query("w04_time_validity", {"own_times": None, "timed": None, "t": 6, "v": 4}, "timeless")
_point_query("w05_speed", {"raw_speed": 4})
_point_query("w06_acceleration", {"acceleration": 5})
_point_query("w07_pauses", {"is_stop": None, "pause": 6})
_point_query("w08_outliers", {"is_outlier": None})
_point_query("w09_inner_stops", {"is_inner_stop": None})
_point_query("w10_cleaned", {"dist": 2, "v": 4})
_point_query("w12_timeless_chain", {"dist": 2, "is_outlier": None}, "timeless")
_point_query("a22_a24_medians", {"median": 6, "mad": 6})


def _ranged_query(name: str, source: str) -> None:
    """Everything that is derived of a point, long tracks cut into ranges; the SQL knows no ranges."""
    columns = {"ds": 3, "dt": 6, "seg_dist": 2, "raw_speed": 4, "acceleration": 5, "median": 6, "mad": 6, "pause": 6, "raw_dist": 2, "dist": 2, "t": 6, "v": 4}
    flags = ["own_times", "timed", "is_stop", "is_outlier", "is_inner_stop"]
    sql = ", ".join([*flags, *(f"round({c}, {n}) AS {c}" for c, n in columns.items())])

    def run(spark: SparkSession, d: str) -> DataFrame:
        # bounds far below the usual ones, so that the given tracks are cut too
        out = ranges.enrich_points(fixture(spark, d, source), longest=50, size=25)
        return out.select(*_KEYS, *flags, *[r(c, n) for c, n in columns.items()])

    register(name, f"{checks.enriched(source)} SELECT track_id, seg_no, pt_no, {sql} FROM e")(run)


_ranged_query("w02_w10_in_ranges", "trackpoints")
_ranged_query("w04_w12_in_ranges", "timeless")


@register("w11_path", f"{_E} SELECT track_id, seg_no, pt_no, lon, lat, round(dist, 2) AS dist FROM e WHERE NOT is_outlier AND NOT is_inner_stop")
def _(spark, d):
    return points.path(tracks(spark, d)).withColumn("dist", F.round("dist", 2))


@register("p02_flattened", f"WITH tp AS ({plain('trackpoints')}) SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY seg_no, pt_no) AS INT) AS pt_no, 0 AS seg_no, ts FROM tp")
def _(spark, d):
    return points.flattened(fixture(spark, d, "trackpoints")).select("track_id", "pt_no", "seg_no", "ts")


@register("p03_valid_tracks", f"WITH tp AS ({plain('trackpoints')}) SELECT DISTINCT track_id FROM (SELECT track_id, seg_no FROM tp GROUP BY 1, 2 HAVING count(*) >= 2)")
def _(spark, d):
    return points.valid_tracks(fixture(spark, d, "trackpoints"))


_G = checks.graphs()


@register("w13_w15_graphs", f"{_G} SELECT track_id, channel, seg_no, g_no, round(s, 2) AS s, round(t, 6) AS t, round(y, 5) AS y FROM g")
def _(spark, d):
    return graph(spark, d).select("track_id", "channel", "seg_no", "g_no", r("s", 2), r("t", 6), r("y", 5))


@register("w14_rezeroed", f"{_G} SELECT track_id, channel, seg_no, count(*) AS n, count(*) FILTER (y = 0) AS zeros, round(sum(y), 3) AS total, round(sum(y * (g_no + 1)), 2) AS placed FROM g WHERE channel IN ('speed', 'reported_speed', 'cadence', 'power') GROUP BY 1, 2, 3")
def _(spark, d):
    g = graph(spark, d, ["speed", "reported_speed", "cadence", "power"])
    sums = F.count("*").alias("n"), F.count_if(F.col("y") == 0).alias("zeros"), F.round(F.sum("y"), 3).alias("total"), F.round(F.sum(F.expr("y * (g_no + 1)")), 2).alias("placed")
    return g.groupBy("track_id", "channel", "seg_no").agg(*sums)


@register("p04_p05_series", f"{_G} SELECT track_id, channel, count(DISTINCT seg_no) AS segments, count(*) AS n FROM g GROUP BY 1, 2")
def _(spark, d):
    return graph(spark, d).groupBy("track_id", "channel").agg(F.countDistinct("seg_no").alias("segments"), F.count("*").alias("n"))


@register(
    "p06_primary_secondary",
    f"""{_G} SELECT track_id, seg_no, g_no, round(y, 5) AS y, 'primary' AS role FROM g WHERE channel = 'reported_speed'
UNION ALL SELECT track_id, seg_no, g_no, round(y, 5), CASE WHEN track_id IN (SELECT track_id FROM g WHERE channel = 'reported_speed') THEN 'secondary' ELSE 'primary' END FROM g WHERE channel = 'speed'""",
)
def _(spark, d):
    g = graph(spark, d, ["speed", "reported_speed"])
    out = channels.primary_secondary(g.where("channel = 'reported_speed'"), g.where("channel = 'speed'"))
    return out.select("track_id", "seg_no", "g_no", r("y", 5), "role")


@register("w16_routes", f"WITH rp AS ({plain('routepoints')}), s AS (SELECT *, coalesce({checks.hav('lag(lon) OVER w', 'lag(lat) OVER w', 'lon', 'lat')}, 0e0) AS ds FROM rp WINDOW w AS (PARTITION BY route_id ORDER BY pt_no)) SELECT route_id, pt_no, round(sum(ds) OVER (PARTITION BY route_id ORDER BY pt_no), 2) AS dist FROM s")
def _(spark, d):
    return routes.with_distance(fixture(spark, d, "routepoints")).select("route_id", "pt_no", r("dist", 2))


@register("w16_route_graph", f"WITH rp AS ({plain('routepoints')}), s AS (SELECT *, coalesce({checks.hav('lag(lon) OVER w', 'lag(lat) OVER w', 'lon', 'lat')}, 0e0) AS ds, count(*) OVER (PARTITION BY route_id) AS n FROM rp WINDOW w AS (PARTITION BY route_id ORDER BY pt_no)) SELECT route_id, CAST(pt_no - 1 AS INT) AS g_no, round(sum(ds) OVER (PARTITION BY route_id ORDER BY pt_no), 2) AS s, ele AS y FROM s WHERE n >= 2")
def _(spark, d):
    return routes.elevation_graph(fixture(spark, d, "routepoints")).select("route_id", F.col("g_no").cast("int").alias("g_no"), r("s", 2), "y")


@register("a05_route_distance", f"WITH rp AS ({plain('routepoints')}), s AS (SELECT *, coalesce({checks.hav('lag(lon) OVER w', 'lag(lat) OVER w', 'lon', 'lat')}, 0e0) AS ds FROM rp WINDOW w AS (PARTITION BY route_id ORDER BY pt_no)) SELECT route_id, round(sum(ds), 2) AS dist, count(*) AS points FROM s GROUP BY 1 HAVING count(*) >= 2")
def _(spark, d):
    return routes.totals(fixture(spark, d, "routepoints")).select("route_id", r("dist", 2), "points")


@register("w17_without_repeats", f"WITH tp AS ({plain('trackpoints')}), s AS (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM tp WINDOW w AS (PARTITION BY track_id, seg_no ORDER BY pt_no)) SELECT track_id, seg_no, pt_no FROM s WHERE NOT coalesce(lon = plon AND lat = plat, false)")
def _(spark, d):
    return points.without_repeats(fixture(spark, d, "trackpoints")).select(*_KEYS)


_TOD = "epoch_us(ts) % 86400000000"


@register("w18_day_rollover", f"WITH tp AS ({plain('trackpoints')}), s AS (SELECT *, CASE WHEN {_TOD} < lag({_TOD}) OVER w THEN 1 ELSE 0 END AS back FROM tp WINDOW w AS (PARTITION BY track_id ORDER BY seg_no * 100000 + pt_no)) SELECT track_id, seg_no, pt_no, CAST(sum(back) OVER (PARTITION BY track_id ORDER BY seg_no * 100000 + pt_no) AS BIGINT) AS day_no FROM s")
def _(spark, d):
    fixes = fixture(spark, d, "trackpoints").withColumns({"at": F.col("seg_no") * 100000 + F.col("pt_no"), "tod": points.micros(F.col("ts")) % 86400000000})
    return points.day_rollover(fixes, ["track_id"], "at", "tod").select(*_KEYS, "day_no")


@register("w18_filled_forward", f"WITH tp AS ({plain('trackpoints')}) SELECT track_id, seg_no, pt_no, last_value(heart_rate IGNORE NULLS) OVER (PARTITION BY track_id, seg_no ORDER BY pt_no) AS filled FROM tp")
def _(spark, d):
    return points.filled_forward(fixture(spark, d, "trackpoints"), ["track_id", "seg_no"], "pt_no", "heart_rate", "filled").select(*_KEYS, "filled")


@register("w21_thinned", f"""{_G}, o AS (SELECT *, max(g_no) OVER (PARTITION BY track_id, channel, seg_no) AS g_last FROM g WHERE channel IN ('heart_rate', 'temperature')),
wk AS (SELECT track_id, channel, seg_no, g_no, s, t, y, g_last, s AS ks, y AS ky, true AS keep FROM o WHERE g_no = 0
  UNION ALL SELECT o.track_id, o.channel, o.seg_no, o.g_no, o.s, o.t, o.y, o.g_last, CASE WHEN KEEP THEN o.s ELSE ks END, CASE WHEN KEEP THEN o.y ELSE ky END, KEEP FROM wk JOIN o ON o.track_id = wk.track_id AND o.channel = wk.channel AND o.seg_no = wk.seg_no AND o.g_no = wk.g_no + 1)
SELECT track_id, channel, seg_no, g_no, round(s, 2) AS s, round(t, 3) AS t, round(y, 4) AS y FROM wk WHERE keep""".replace("KEEP", "(o.g_no = o.g_last OR abs(o.s * 1e-5 - ks * 1e-5) >= 1 OR abs(o.y * 0.2e0 - ky * 0.2e0) >= 1)").replace("WITH", "WITH RECURSIVE", 1))
def _(spark, d):
    out = thinning.thinned(graph(spark, d, ["heart_rate", "temperature"]), 1e-5, 0.2)
    return out.select("track_id", "channel", "seg_no", "g_no", r("s", 2), r("t", 3), r("y", 4))


_M = f"WITH m AS ({plain('messages')})"


@register("w23_gear_ratio", f"{_M} SELECT file, ord, round(last_value(CASE WHEN kind = 'event' THEN front / CAST(rear AS DOUBLE) END IGNORE NULLS) OVER (PARTITION BY file ORDER BY ord), 6) AS ratio FROM m")
def _(spark, d):
    return sessions.with_ratio(fixture(spark, d, "messages")).select("file", "ord", r("ratio", 6))


@register("w24_segments", f"{_M}, s AS (SELECT *, coalesce(sum(CASE WHEN stop THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg_no FROM m) SELECT file, ord, CAST(seg_no AS BIGINT) AS seg_no FROM s WHERE kind = 'record'")
def _(spark, d):
    return sessions.segmented(fixture(spark, d, "messages")).select("file", "ord", "seg_no")


@register("w24_laps", f"{_M}, l AS (SELECT file, ts, row_number() OVER (PARTITION BY file ORDER BY ord) AS lap_no, count(*) OVER (PARTITION BY file) AS n FROM m WHERE kind = 'lap') SELECT file, CAST(lap_no AS INT) AS lap_no, CASE WHEN lap_no = n THEN 'Finish' ELSE 'Lap ' || lap_no END AS name, ts FROM l WHERE n > 1")
def _(spark, d):
    return sessions.laps(fixture(spark, d, "messages"))


_T = checks.track_totals()


@register("a01_a04_track_totals", f"{_T} SELECT track_id, round(dist, 2) AS dist, round(time, 6) AS time, round(pause, 6) AS pause, round(moving_time, 6) AS moving_time, started FROM tt")
def track_totals(spark, d):
    t = stats.track_totals(tracks(spark, d))
    return t.select("track_id", r("dist", 2), r("time", 6), r("pause", 6), r("moving_time", 6), "started")


_S = checks.series_stats()


@register("a06_a07_series", f"{_S} SELECT track_id, channel, n, round(y_min, 5) AS y_min, round(y_max, 5) AS y_max, round(y_avg, 4) AS y_avg, round(s_last, 2) AS s_last FROM st")
def _(spark, d):
    return stats.series_stats(graph(spark, d)).select("track_id", "channel", "n", r("y_min", 5), r("y_max", 5), r("y_avg", 4), r("s_last", 2))


_CLIMB = """,
cl AS (SELECT track_id, sum(greatest(up, 0e0)) AS ascent, sum(greatest(-up, 0e0)) AS descent, max(y) AS ele_max, min(y) AS ele_min
  FROM (SELECT *, coalesce(y - lag(y) OVER (PARTITION BY track_id, seg_no ORDER BY g_no), 0e0) AS up FROM g WHERE channel = 'elevation') GROUP BY track_id)"""


@register("a08_climb", f"{_G}{_CLIMB} SELECT track_id, round(ascent, 4) AS ascent, round(descent, 4) AS descent, round(ele_max, 4) AS ele_max, round(ele_min, 4) AS ele_min FROM cl")
def _(spark, d):
    c = stats.climb(graph(spark, d, ["elevation"]))
    return c.select("track_id", r("ascent", 4), r("descent", 4), r("ele_max", 4), r("ele_min", 4))


_SPEED = """,
tt AS (SELECT track_id, max_by(t, seg_no * 1000000 + pt_no) FILTER (NOT is_outlier) - sum(pause) AS moving_time FROM e GROUP BY track_id),
sp AS (SELECT st.track_id, s_last AS dist, y_max AS speed_max, s_last / t_last AS speed_avg, s_last / moving_time AS moving_avg FROM st JOIN tt USING (track_id) WHERE channel = 'speed')"""


@register("a09_a10_speed_pace", f"{_S}{_SPEED} SELECT track_id, round(speed_max, 4) AS speed_max, round(speed_avg, 5) AS speed_avg, round(moving_avg, 5) AS moving_avg, round(3600 / (speed_avg * 3.6), 4) AS pace, round(3600 / (moving_avg * 3.6), 4) AS moving_pace FROM sp")
def _(spark, d):
    e = tracks(spark, d)
    out = stats.speeds(channels.graph(e, ["speed"]), stats.track_totals(e))
    return out.select("track_id", r("speed_max", 4), r("speed_avg", 5), r("moving_avg", 5), r("pace", 4), r("moving_pace", 4))


@register("a11_averages", f"{_S} SELECT channel, round(sum(y_avg * s_last) / sum(s_last), 4) AS avg, count(*) AS tracks FROM st GROUP BY 1")
def _(spark, d):
    return stats.collection_averages(stats.series_stats(graph(spark, d)), ["channel"], "y_avg").select("channel", r("avg", 4), "tracks")


@register("a12_max_speed", f"{_S} SELECT round(greatest(max(y_max), 0e0), 4) AS speed_max FROM st WHERE channel = 'speed'")
def _(spark, d):
    return stats.series_stats(graph(spark, d, ["speed"])).agg(F.round(F.greatest(F.max("y_max"), F.lit(0.0)), 4).alias("speed_max"))


_RCLIMB = f""",
rp AS ({plain('routepoints')}),
rc AS (SELECT route_id, sum(greatest(up, 0e0)) AS ascent, sum(greatest(-up, 0e0)) AS descent, max(ele) AS ele_max, min(ele) AS ele_min FROM
  (SELECT *, coalesce(ele - lag(ele) OVER (PARTITION BY route_id ORDER BY pt_no), 0e0) AS up, count(*) OVER (PARTITION BY route_id) AS n FROM rp) WHERE n >= 2 GROUP BY 1)"""


@register(
    "a13_elevation_by_kind",
    f"""{_G}{_CLIMB}{_RCLIMB}, u AS (SELECT 'track' AS kind, ascent, descent, ele_max, ele_min FROM cl UNION ALL SELECT 'route', ascent, descent, ele_max, ele_min FROM rc)
SELECT kind, round(sum(ascent), 2) AS ascent, round(sum(descent), 2) AS descent, round(max(ele_max), 4) AS ele_max, round(min(ele_min), 4) AS ele_min, CAST(grouping(kind) AS INT) AS is_total FROM u GROUP BY GROUPING SETS ((kind), ())""",
)
def _(spark, d):
    of_tracks = stats.climb(graph(spark, d, ["elevation"])).withColumn("kind", F.lit("track"))
    g = routes.elevation_graph(fixture(spark, d, "routepoints")).select(F.col("route_id").alias("track_id"), F.lit(0).alias("seg_no"), "g_no", "y", F.lit("elevation").alias("channel"))
    of_routes = stats.climb(g).withColumn("kind", F.lit("route"))
    out = stats.elevation_by_kind(of_tracks.unionByName(of_routes))
    return out.select("kind", r("ascent", 2), r("descent", 2), r("ele_max", 4), r("ele_min", 4), "is_total")


@register("a14_channel_range", f"{_G} SELECT channel, round(min(y), 5) AS y_min, round(max(y), 5) AS y_max FROM g GROUP BY 1")
def _(spark, d):
    return graph(spark, d).groupBy("channel").agg(F.round(F.min("y"), 5).alias("y_min"), F.round(F.max("y"), 5).alias("y_max"))


_HIST = """,
hs AS (SELECT track_id, y, sum(step) AS ridden FROM (SELECT *, coalesce(s - lag(s) OVER (PARTITION BY track_id, seg_no ORDER BY g_no), 0e0) AS step FROM g WHERE channel = 'ratio') GROUP BY 1, 2)"""


@register("a15_ratio_histogram", f"{_G}{_HIST} SELECT track_id, round(y, 4) AS y, round(ridden, 2) AS ridden FROM hs")
def _(spark, d):
    return stats.value_histogram(graph(spark, d, ["ratio"])).select("track_id", r("y", 4), r("ridden", 2))


@register("a15_top_ratio", f"{_G}{_HIST} SELECT track_id, arg_min(round(y, 4), (-ridden, y)) AS top, round(max(ridden), 2) AS ridden FROM hs GROUP BY 1")
def _(spark, d):
    return stats.most_used(stats.value_histogram(graph(spark, d, ["ratio"])), ["track_id"]).select("track_id", r("top", 4), r("ridden", 2))


@register("a16_merged_histogram", f"{_G}{_HIST} SELECT round(y, 4) AS y, round(sum(ridden), 1) AS ridden FROM hs GROUP BY 1")
def _(spark, d):
    return stats.merged_histogram(stats.value_histogram(graph(spark, d, ["ratio"]))).select(r("y", 4), r("ridden", 1))


@register("a17_a18_collection", f"{_T} SELECT count(*) AS tracks, round(sum(dist), 1) AS dist, round(sum(time), 3) AS time, round(sum(moving_time), 3) AS moving_time, min(started) AS first_date, max(started) AS last_date FROM tt")
def _(spark, d):
    out = stats.collection_totals(stats.track_totals(tracks(spark, d)))
    return out.select("tracks", r("dist", 1), r("time", 3), r("moving_time", 3), "first_date", "last_date")


@register(
    "a19_report",
    f"""{_S}{_CLIMB}{_SPEED.split('sp AS')[0].rstrip().rstrip(',').replace('tt AS (SELECT track_id,', 'tt AS (SELECT track_id, coalesce(max_by(dist, seg_no * 1000000 + pt_no) FILTER (NOT is_outlier), 0e0) AS dist, max_by(t, seg_no * 1000000 + pt_no) FILTER (NOT is_outlier) AS time,')}
SELECT 'tracks' AS metric, CAST(count(*) AS DOUBLE) AS value FROM tt UNION ALL SELECT 'distance', round(sum(dist), 2) FROM tt UNION ALL SELECT 'time', round(sum(time), 2) FROM tt
UNION ALL SELECT 'moving_time', round(sum(moving_time), 2) FROM tt UNION ALL SELECT 'ascent', round(sum(ascent), 2) FROM cl UNION ALL SELECT 'descent', round(sum(descent), 2) FROM cl
UNION ALL SELECT channel || '_min', round(min(y_min), 2) FROM st GROUP BY channel UNION ALL SELECT channel || '_max', round(max(y_max), 2) FROM st GROUP BY channel
UNION ALL SELECT channel || '_avg', round(sum(y_avg * s_last) / sum(s_last), 2) FROM st GROUP BY channel""",
)
def _(spark, d):
    e = tracks(spark, d)
    g = channels.graph(e)
    out = stats.report(stats.track_totals(e), stats.series_stats(g), stats.climb(g))
    return out.select("metric", r("value", 2))


@register("a29_time_quality", f"WITH tp AS ({plain('timeless')}), s AS (SELECT *, lag(ts) OVER (PARTITION BY track_id, seg_no ORDER BY pt_no) AS pts FROM tp) SELECT track_id, count(*) FILTER (ts <= pts) AS skewed, count(*) FILTER (ts IS NULL) AS missing, count(*) AS points FROM s GROUP BY 1")
def _(spark, d):
    return stats.time_quality(fixture(spark, d, "timeless"), ["track_id"])
