"""Queries over places: spatial joins, boxes, lookups along paths, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import channels, lookup, spatial
from waymark.operators.lineage import checkpointed
from waymark.plans import checks
from waymark.plans.catalog import Register
from waymark.plans.fixtures import fixture, plain
from waymark.plans.motion import graph, r, tracks

register = Register()


def box_sql(lon: str, lat: str, radius: float) -> str:
    a = f"{radius / geo.EARTH_RADIUS!r}"
    reach = f"degrees(asin(least(sin({a}) / cos(radians({lat})), 1e0)))"
    return f"{lon} - {reach} AS west, {lat} - degrees({a}) AS south, {lon} + {reach} AS east, {lat} + degrees({a}) AS north"


_ARC = """
2 * asin(sqrt(power(sin((radians(nlat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(nlat)) * power(sin((radians(nlon) - radians(lon)) / 2), 2)))"""


def arc_sql(part: str) -> str:
    """lon and lat at ``part`` of the great circle from (lon, lat) to (nlon, nlat), arc being its angle; equal points stay, as in ``geo.great_circle``."""
    a, b = f"(sin((1 - {part}) * arc) / sin(arc))", f"(sin({part} * arc) / sin(arc))"
    x = f"({a} * cos(radians(lat)) * cos(radians(lon)) + {b} * cos(radians(nlat)) * cos(radians(nlon)))"
    y = f"({a} * cos(radians(lat)) * sin(radians(lon)) + {b} * cos(radians(nlat)) * sin(radians(nlon)))"
    z = f"({a} * sin(radians(lat)) + {b} * sin(radians(nlat)))"
    # equal points stay
    return f"CASE WHEN sin(arc) = 0 THEN lon ELSE degrees(atan2({y}, {x})) END AS alon, CASE WHEN sin(arc) = 0 THEN lat ELSE degrees(atan2({z}, sqrt({x} * {x} + {y} * {y}))) END AS alat"


_PATH = checks.enriched() + ",\npa AS (SELECT track_id, seg_no, pt_no, lon, lat, dist FROM e WHERE NOT is_outlier AND NOT is_inner_stop)"
_DENSE = f"""{_PATH},
d1 AS (SELECT *, lead(lon) OVER w AS nlon, lead(lat) OVER w AS nlat, lead(dist) OVER w AS ndist FROM pa WINDOW w AS (PARTITION BY track_id, seg_no ORDER BY pt_no)),
d2 AS (SELECT *, CASE WHEN ndist IS NULL THEN 1 ELSE greatest(CAST(ceil((ndist - dist) / RADIUS) AS INT), 1) END AS n, {_ARC} AS arc FROM d1),
d3 AS (SELECT *, unnest(range(n)) AS k FROM d2),
d4 AS (SELECT *, {arc_sql('(k / CAST(n AS DOUBLE))')} FROM d3),
dn AS (SELECT track_id, CASE WHEN k = 0 THEN lon ELSE alon END AS lon, CASE WHEN k = 0 THEN lat ELSE alat END AS lat FROM d4)"""


@register("h27_densified", _DENSE.replace("RADIUS", "5000e0") + " SELECT track_id, count(*) AS n, round(sum(lon), 3) AS lons, round(sum(lat), 3) AS lats FROM dn GROUP BY 1")
def _(spark, d):
    out = spatial.densified(spatial_path(spark, d), 5000.0)
    return out.groupBy("track_id").agg(F.count("*").alias("n"), F.round(F.sum("lon"), 3).alias("lons"), F.round(F.sum("lat"), 3).alias("lats"))


def spatial_path(spark, d):
    from waymark.operators import points

    return points.path(tracks(spark, d))


_CORRIDOR = (
    _DENSE.replace("RADIUS", "1000e0")
    + f""",
bx AS (SELECT DISTINCT track_id, {box_sql('lon', 'lat', 1000.0)} FROM dn),
cb AS (SELECT *, unnest(range(CAST(floor(west / 0.05) AS BIGINT), CAST(floor(east / 0.05) AS BIGINT) + 1)) AS cx FROM bx),
po AS ({plain('pois')}),
hit AS (SELECT DISTINCT track_id, wpt_id, name, file, lon, lat FROM cb JOIN po ON cx = CAST(floor(lon / 0.05) AS BIGINT) AND lon BETWEEN west AND east AND lat BETWEEN south AND north)"""
)


@register("j01_corridor", _CORRIDOR + " SELECT track_id, wpt_id FROM hit")
def _(spark, d):
    return spatial.near_paths(spatial_path(spark, d), fixture(spark, d, "pois").select("wpt_id", "lon", "lat")).select("track_id", "wpt_id")


@register(
    "j02_near_points",
    f"WITH rp AS ({plain('routepoints')}), po AS ({plain('pois')}), b AS (SELECT DISTINCT lon AS at_lon, lat AS at_lat, {box_sql('lon', 'lat', 1000.0)} FROM rp) SELECT at_lon, at_lat, wpt_id FROM b JOIN po ON lon BETWEEN west AND east AND lat BETWEEN south AND north",
)
def _(spark, d):
    places = fixture(spark, d, "routepoints").select("lon", "lat", F.col("lon").alias("at_lon"), F.col("lat").alias("at_lat")).distinct()
    return spatial.near_points(places, fixture(spark, d, "pois"), ["at_lon", "at_lat"]).select("at_lon", "at_lat", "wpt_id")


_M = f"degrees({1000.0 / geo.EARTH_RADIUS!r})"
_GROWN = f"""ar AS ({plain('areas')}),
gr AS (SELECT area_id, west - {_M} AS w0, greatest(south - {_M}, -90e0) AS south, east + {_M} AS e0, least(north + {_M}, 90e0) AS north FROM ar),
gb AS (SELECT area_id, south, north, w0 - 360 * round_even(w0 / 360, 0) AS west, e0 - 360 * round_even(e0 / 360, 0) AS east FROM gr),
sp AS (SELECT area_id, west, south, CASE WHEN west > east THEN 180e0 ELSE east END AS east, north FROM gb UNION ALL SELECT area_id, -180e0, south, east, north FROM gb WHERE west > east)"""


@register("j03_j04_near_areas", f"WITH {_GROWN}, po AS ({plain('pois')}) SELECT DISTINCT area_id, wpt_id FROM sp JOIN po ON lon BETWEEN west AND east AND lat BETWEEN south AND north")
def _(spark, d):
    areas = fixture(spark, d, "areas").select("area_id", "west", "south", "east", "north")
    return spatial.near_boxes(areas, fixture(spark, d, "pois").select("wpt_id", "lon", "lat"), ["area_id"]).select("area_id", "wpt_id")


@register("h06_grown_boxes", f"WITH {_GROWN} SELECT area_id, round(west, 6) AS west, round(south, 6) AS south, round(east, 6) AS east, round(north, 6) AS north FROM gb")
def _(spark, d):
    box = geo.box_grown(geo.box_columns(), F.degrees(F.lit(1000.0 / geo.EARTH_RADIUS)))
    return fixture(spark, d, "areas").select("area_id", *[F.round(c, 6).alias(k) for k, c in box.items()])


@register("j04_h08_split_boxes", f"WITH {_GROWN} SELECT area_id, count(*) AS parts, round(sum(east - west), 6) AS degrees_wide FROM sp GROUP BY 1")
def _(spark, d):
    box = geo.box_grown(geo.box_columns(), F.degrees(F.lit(1000.0 / geo.EARTH_RADIUS)))
    rows = fixture(spark, d, "areas").select("area_id", F.explode(geo.split_at_date_line(box["west"], box["south"], box["east"], box["north"])).alias("b"))
    return rows.groupBy("area_id").agg(F.count("*").alias("parts"), F.round(F.sum(F.col("b.east") - F.col("b.west")), 6).alias("degrees_wide"))


@register("h05_boxes_around", f"WITH po AS ({plain('pois')}) SELECT wpt_id, round(west, 6) AS west, round(south, 6) AS south, round(east, 6) AS east, round(north, 6) AS north FROM (SELECT wpt_id, {box_sql('lon', 'lat', 2500.0)} FROM po)")
def _(spark, d):
    box = geo.box_around(F.col("lon"), F.col("lat"), 2500.0)
    return fixture(spark, d, "pois").select("wpt_id", *[F.round(c, 6).alias(k) for k, c in box.items()])


@register("h07_t03_box_sizes", f"WITH ar AS ({plain('areas')}), s AS (SELECT area_id, CASE WHEN west > east THEN 360 - (west - east) ELSE east - west END AS width, north - south AS height FROM ar) SELECT area_id, round(width, 6) AS width, round(height, 6) AS height, round(width * height, 6) AS area FROM s ORDER BY area DESC, area_id")
def _(spark, d):
    rows = fixture(spark, d, "areas").select(
        "area_id",
        F.round(geo.box_width(F.col("west"), F.col("east")), 6).alias("width"),
        F.round(F.col("north") - F.col("south"), 6).alias("height"),
        F.round(geo.box_area(F.col("west"), F.col("south"), F.col("east"), F.col("north")), 6).alias("area"),
    )
    return rows.orderBy(F.desc("area"), "area_id")


@register("h01_h04_great_circle", f"WITH rp AS ({plain('routepoints')}), s AS (SELECT route_id, pt_no, lon, lat, lead(lon) OVER w AS nlon, lead(lat) OVER w AS nlat FROM rp WINDOW w AS (PARTITION BY route_id ORDER BY pt_no)), a AS (SELECT *, {_ARC} AS arc FROM s WHERE nlon IS NOT NULL AND (nlon <> lon OR nlat <> lat)), b AS (SELECT *, {arc_sql('0.25e0')} FROM a) SELECT route_id, pt_no, round({checks.hav('lon', 'lat', 'nlon', 'nlat')}, 2) AS dist, round(alon, 6) AS alon, round(alat, 6) AS alat FROM b")
def _(spark, d):
    from pyspark.sql import Window

    nxt = F.lead(F.struct("lon", "lat")).over(Window.partitionBy("route_id").orderBy("pt_no"))
    rows = fixture(spark, d, "routepoints").withColumn("n", nxt).where("n is not null and (n.lon <> lon or n.lat <> lat)")
    ends = F.col("lon"), F.col("lat"), F.col("n.lon"), F.col("n.lat")
    lon, lat = geo.great_circle(*ends, F.lit(0.25))
    return rows.select("route_id", "pt_no", F.round(geo.distance(*ends), 2).alias("dist"), F.round(lon, 6).alias("alon"), F.round(lat, 6).alias("alat"))


@register("h03_antipodes", f"""WITH po AS ({plain('pois')}), a AS (SELECT wpt_id, (wpt_id % 180) + 0e0 AS lon, (wpt_id % 179) - 89e0 AS lat FROM po), b AS (SELECT *, lon - 180 + 1e-5 AS nlon, -lat + 1e-5 AS nlat FROM a), c AS (SELECT *, {_ARC} AS arc FROM b), q AS (SELECT *, {arc_sql('0.25e0')} FROM c) SELECT wpt_id, round(alon, 3) AS alon, round(alat, 3) AS alat FROM q""")
def _(spark, d):
    """Opposite places are moved apart a little, so that a great circle between them exists."""
    rows = fixture(spark, d, "pois").select("wpt_id", (F.col("wpt_id") % 180).cast("double").alias("lon"), (F.col("wpt_id") % 179 - 89).cast("double").alias("lat"))
    lon, lat = geo.great_circle(F.col("lon"), F.col("lat"), F.col("lon") - 180.0, -F.col("lat"), F.lit(0.25))
    return rows.select("wpt_id", F.round(lon, 3).alias("alon"), F.round(lat, 3).alias("alat"))


@register("h08_date_line", f"WITH po AS ({plain('pois')}), s AS (SELECT wpt_id, (wpt_id % 360) - 180e0 AS lon1, lat AS lat1, ((wpt_id * 7 + 170) % 360) - 180e0 AS lon2, lat + 1 AS lat2 FROM po), t AS (SELECT *, CASE WHEN lon1 < 0 THEN lon1 + 360 ELSE lon1 END AS s1, CASE WHEN lon2 < 0 THEN lon2 + 360 ELSE lon2 END AS s2 FROM s) SELECT wpt_id, round(lat1 + (180 - s1) * (lat2 - lat1) / (s2 - s1), 6) AS at_lat FROM t WHERE abs(lon2 - lon1) > 180 AND s1 <> s2")
def _(spark, d):
    rows = fixture(spark, d, "pois").select("wpt_id", ((F.col("wpt_id") % 360) - 180.0).alias("lon1"), F.col("lat").alias("lat1"), ((F.col("wpt_id") * 7 + 170) % 360 - 180.0).alias("lon2"), (F.col("lat") + 1).alias("lat2"))
    at = geo.date_line_crossing(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2"))
    return rows.select("wpt_id", F.round(at, 6).alias("at_lat")).where("at_lat is not null")


@register("j05_elevations", f"""WITH tp AS ({plain('trackpoints')}), dm AS ({plain('dem')}),
l AS (SELECT track_id, seg_no, pt_no, lon, lat, CAST(floor(lon) AS INT) AS tx, CAST(floor(lat) AS INT) AS ty FROM tp),
c AS (SELECT *, (lon - tx) * 20 AS x, (lat - ty) * 20 AS y FROM l), f AS (SELECT *, CAST(floor(x) AS INT) AS col0, CAST(floor(y) AS INT) AS row0 FROM c),
k AS (SELECT f.*, dr, dc FROM f CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(dr, dc))
SELECT track_id, seg_no, pt_no, round(CASE WHEN count(z) = 4 THEN sum(z * (CASE WHEN dc = 1 THEN x - col0 ELSE 1 - (x - col0) END) * (CASE WHEN dr = 1 THEN y - row0 ELSE 1 - (y - row0) END)) END, 4) AS elevation
FROM k LEFT JOIN dm ON dm.tile_lon = tx AND dm.tile_lat = ty AND dm.row = row0 + dr AND dm.col = col0 + dc GROUP BY 1, 2, 3""")
def _(spark, d):
    from waymark.operators import terrain

    return terrain.elevations(fixture(spark, d, "trackpoints"), fixture(spark, d, "dem"), ["track_id", "seg_no", "pt_no"]).withColumn("elevation", F.round("elevation", 4))


@register("j06_next_sample", f"WITH tp AS ({plain('trackpoints')}), m AS ({plain('messages')}), s AS (SELECT CAST(file AS BIGINT) AS track_id, ts AS sts, front, rear FROM m WHERE kind = 'event') SELECT tp.track_id, pt_no, seg_no, front, rear FROM tp ASOF LEFT JOIN s ON tp.track_id = s.track_id AND tp.ts <= s.sts")
def _(spark, d):
    samples = fixture(spark, d, "messages").where("kind = 'event'").select(F.col("file").cast("long").alias("track_id"), "ts", F.col("ord").alias("nth"), "front", "rear")
    found = lookup.next_sample(fixture(spark, d, "trackpoints"), samples, ["track_id"], "ts", ["front", "rear"])
    return found.select("track_id", "pt_no", "seg_no", "front", "rear")


def _probe_sql(y: str, x: str, source: str) -> str:
    return f"""
iv AS (SELECT track_id, seg_no, {x} AS x0, lead({x}) OVER w AS x1, {y} AS y0, lead({y}) OVER w AS y1 FROM {source} WINDOW w AS (PARTITION BY track_id, seg_no ORDER BY g_no)),
pr AS (SELECT track_id, 5000e0 * (track_id % 7 + 1) * k AS pos FROM (SELECT DISTINCT track_id FROM {source}) CROSS JOIN range(1, 6) r(k)),
ht AS (SELECT pr.track_id, pos, arg_min(y0 + CASE WHEN x1 > x0 THEN (pos - x0) / (x1 - x0) ELSE 0 END * (y1 - y0), (seg_no, x0)) AS y FROM pr JOIN iv ON pr.track_id = iv.track_id AND pos >= x0 AND pos <= x1 GROUP BY 1, 2)"""


def _probes(rows):
    k = F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k")
    return rows.select("track_id").distinct().select("track_id", k).select("track_id", (F.lit(5000.0) * (F.col("track_id") % 7 + 1) * F.col("k")).alias("at"))


@register("j07_interpolated", f"{checks.graphs()}, q AS (SELECT * FROM g WHERE channel = 'heart_rate'), {_probe_sql('y', 's', 'q')} SELECT pr.track_id, pr.pos AS \"at\", round(y, 4) AS y FROM pr LEFT JOIN ht ON pr.track_id = ht.track_id AND pr.pos = ht.pos")
def _(spark, d):
    g = checkpointed(graph(spark, d, ["heart_rate"]))  # read twice
    return lookup.interpolated(_probes(g), g, ["track_id"], "s", "y").select("track_id", "at", r("y", 4))


@register("j07b_distance_at_time", f"{checks.graphs()}, q AS (SELECT * FROM g WHERE channel = 'heart_rate'), {_probe_sql('s', 't', 'q')} SELECT pr.track_id, pr.pos AS \"at\", round(y, 3) AS s FROM pr LEFT JOIN ht ON pr.track_id = ht.track_id AND pr.pos = ht.pos")
def _(spark, d):
    g = checkpointed(graph(spark, d, ["heart_rate"]))  # read twice
    return lookup.interpolated(_probes(g), g, ["track_id"], "t", "s").select("track_id", "at", r("s", 3))


_POS = f"""{_PATH},
i1 AS (SELECT *, lead(lon) OVER w AS nlon, lead(lat) OVER w AS nlat, lead(dist) OVER w AS ndist FROM pa WINDOW w AS (PARTITION BY track_id, seg_no ORDER BY pt_no)),
i2 AS (SELECT *, {_ARC} AS arc FROM i1 WHERE ndist IS NOT NULL),
mk AS (SELECT track_id, unnest(range(1, CAST(floor(e / 100000) AS BIGINT) + 1)) * 100000e0 AS pos FROM (SELECT track_id, max(dist) AS e FROM pa GROUP BY 1) WHERE e >= 100000),
i3 AS (SELECT i2.*, pos, CASE WHEN ndist > dist THEN (pos - dist) / (ndist - dist) ELSE 0e0 END AS part FROM mk JOIN i2 ON mk.track_id = i2.track_id AND pos >= dist AND pos <= ndist),
i4 AS (SELECT *, {arc_sql('part')} FROM i3),
i5 AS (SELECT track_id, pos, arg_min(CASE WHEN ndist - dist > {geo.LONG_STEP} THEN alon ELSE lon + part * (nlon - lon) END, (seg_no, dist)) AS lon, arg_min(CASE WHEN ndist - dist > {geo.LONG_STEP} THEN alat ELSE lat + part * (nlat - lat) END, (seg_no, dist)) AS lat FROM i4 GROUP BY 1, 2)"""


@register("j07c_h28_markers", f"{_POS} SELECT mk.track_id, mk.pos AS \"at\", round(lon, 5) AS lon, round(lat, 5) AS lat FROM mk LEFT JOIN i5 ON mk.track_id = i5.track_id AND mk.pos = i5.pos")
def _(spark, d):
    return lookup.distance_markers(spatial_path(spark, d), 100_000.0).select("track_id", "at", r("lon", 5), r("lat", 5))


@register("j07c_position_at", f"{_POS}, z AS (SELECT * FROM mk) SELECT z.track_id, z.pos AS \"at\", round(lon, 5) AS lon, round(lat, 5) AS lat FROM z LEFT JOIN i5 ON z.track_id = i5.track_id AND z.pos = i5.pos")
def _(spark, d):
    path = checkpointed(spatial_path(spark, d))  # read twice
    ends = path.groupBy("track_id").agg(F.floor(F.max("dist") / 100_000.0).alias("k")).where("k >= 1")
    probes = ends.select("track_id", F.explode(F.sequence(F.lit(1).cast("long"), "k")).alias("k")).select("track_id", (F.col("k") * 100_000.0).alias("at"))
    return lookup.position_at(probes, path).select("track_id", "at", r("lon", 5), r("lat", 5))


@register("j07d_wall_clock", f"{checks.graphs()}, q AS (SELECT * FROM g WHERE channel = 'heart_rate'), {_probe_sql('t', 's', 'q').replace('(seg_no, x0)) AS y', '(seg_no, x0)) AS y, min(seg_no) AS seg_no')}, f AS (SELECT track_id, seg_no, min_by(ts, pt_no) AS seg_start, min_by(t, pt_no) AS t0 FROM e GROUP BY 1, 2) SELECT ht.track_id, ht.pos AS \"at\", ht.seg_no, epoch_us(seg_start) + CAST(round((y - t0) * 1e6) AS BIGINT) AS clock_us FROM ht JOIN f ON f.track_id = ht.track_id AND f.seg_no = ht.seg_no")
def _(spark, d):
    points = tracks(spark, d)
    series = channels.graph(points, ["heart_rate"])
    first = points.groupBy("track_id", "seg_no").agg(F.min_by("ts", "pt_no").alias("seg_start"), F.min_by("t", "pt_no").alias("t0"))
    found = lookup.interpolated(_probes(series), series, ["track_id"], "s", "t", with_segment=True).join(first, ["track_id", "seg_no"])
    clock = lookup.wall_clock(F.col("t"), F.col("seg_start"), F.col("t0"))
    return found.select("track_id", "at", "seg_no", F.unix_micros(clock).alias("clock_us"))


@register("j09_turnpoints", f"""WITH po AS ({plain('pois')}), ta AS (SELECT DISTINCT c_mktsegment AS file, c_nationkey AS task_no FROM customer),
nm AS (SELECT c_mktsegment AS file, c_nationkey AS task_no, unnest([max(c_name), '???', min(c_name), 'nowhere']) AS name, unnest(range(4)) AS place FROM customer GROUP BY 1, 2),
fi AS (SELECT file, name, arg_min(lon, wpt_id) AS lon, arg_min(lat, wpt_id) AS lat FROM po GROUP BY 1, 2)
SELECT nm.file, task_no, CAST(place AS INT) AS place, nm.name, lon, lat FROM nm JOIN fi ON nm.file = fi.file AND nm.name = fi.name WHERE nm.name <> '???'""")
def _(spark, d):
    tasks = spark.read.parquet(f"{d}/customer.parquet").groupBy(F.col("c_mktsegment").alias("file"), F.col("c_nationkey").alias("task_no")).agg(
        F.array(F.max("c_name"), F.lit("???"), F.min("c_name"), F.lit("nowhere")).alias("names")
    )
    good, _bad = lookup.named_turnpoints(tasks, fixture(spark, d, "pois").withColumn("wpt_no", F.col("wpt_id")))
    return good


@register("j09_unknown_names", "SELECT DISTINCT c_mktsegment AS file, c_nationkey AS task_no, 'nowhere' AS name FROM customer")
def _(spark, d):
    tasks = spark.read.parquet(f"{d}/customer.parquet").groupBy(F.col("c_mktsegment").alias("file"), F.col("c_nationkey").alias("task_no")).agg(F.array(F.min("c_name"), F.lit("nowhere")).alias("names"))
    return lookup.named_turnpoints(tasks, fixture(spark, d, "pois").withColumn("wpt_no", F.col("wpt_id")))[1]


@register("j10_styles", """WITH i AS (SELECT o_orderkey AS item, o_orderpriority AS style_id FROM orders), s AS (SELECT '1-URGENT' AS style_id, 'red' AS style UNION ALL SELECT 'base', 'blue'), m AS (SELECT '2-HIGH' AS map_id, 'base' AS target)
SELECT item, coalesce(s.style, t.style, 'plain') AS style FROM i LEFT JOIN s ON i.style_id = s.style_id LEFT JOIN m ON i.style_id = m.map_id LEFT JOIN s t ON m.target = t.style_id""")
def _(spark, d):
    items = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("item"), F.col("o_orderpriority").alias("style_id"))
    styles = spark.createDataFrame([("1-URGENT", "red"), ("base", "blue")], "style_id string, style string")
    maps = spark.createDataFrame([("2-HIGH", "base")], "map_id string, target string")
    return lookup.style_of(items, styles, maps, "plain").select("item", "style")


_FEAT = f"""WITH ar AS (SELECT area_id, south, north, unnest(CASE WHEN west > east THEN [west, -180e0] ELSE [west] END) AS west, unnest(CASE WHEN west > east THEN [180e0, east] ELSE [east] END) AS east FROM ({plain('areas')})), fe AS ({plain('features')})"""
_SIDES = ("west", "south", "east", "north")


@register("j11_features_in_boxes", f"""{_FEAT}, pt AS (SELECT id, 'point' AS part, lon, lat FROM fe WHERE kind = 'node' UNION ALL SELECT id, 'area', (west + east) / 2, (south + north) / 2 FROM fe WHERE kind = 'way' AND closed)
SELECT area_id, id, part FROM ar JOIN pt ON lon BETWEEN west AND east AND lat BETWEEN south AND north
UNION ALL SELECT area_id, id, 'path' FROM ar JOIN fe ON kind = 'way' AND NOT closed AND ar.east >= fe.west AND ar.west <= fe.east AND ar.north >= fe.south AND ar.south <= fe.north""")
def _(spark, d):
    areas = fixture(spark, d, "areas").select("area_id", *_SIDES)
    return spatial.features_in_boxes(areas, fixture(spark, d, "features"), ["area_id"])


@register("j12_charts", f"""{_FEAT}, ch AS (SELECT id % 50 AS chart_id, min(lon) AS west, min(lat) AS south, min(lon) + 0.3e0 AS east, min(lat) + 0.2e0 AS north FROM fe GROUP BY 1),
mt AS (SELECT DISTINCT area_id, chart_id FROM ar JOIN ch ON ar.east >= ch.west AND ar.west <= ch.east AND ar.north >= ch.south AND ar.south <= ch.north)
SELECT mt.area_id, chart_id, fe.id FROM mt JOIN fe ON fe.id % 50 = chart_id JOIN ar ON ar.area_id = mt.area_id AND fe.lon BETWEEN ar.west AND ar.east AND fe.lat BETWEEN ar.south AND ar.north""")
def _(spark, d):
    features = fixture(spark, d, "features").withColumn("chart_id", F.col("id") % 50)
    charts = features.groupBy("chart_id").agg(F.min("lon").alias("west"), F.min("lat").alias("south")).withColumns({"east": F.col("west") + 0.3, "north": F.col("south") + 0.2})
    areas = fixture(spark, d, "areas").select("area_id", *_SIDES)
    return spatial.charts_then_features(areas, charts, features.select("chart_id", "id", "lon", "lat"), ["area_id"])


_COVER = f"""ar AS (SELECT *, west - 2 AS w2, east + 2 AS e2 FROM ({plain('areas')})), cv AS (SELECT area_id, CAST(x AS INT) AS tile_lon, CAST(y AS INT) AS tile_lat FROM ar, range(-180, 180) rx(x), range(-90, 91) ry(y)
WHERE CASE WHEN w2 > e2 THEN x >= floor(w2) OR x <= floor(e2) ELSE x BETWEEN floor(w2) AND floor(e2) END AND y BETWEEN floor(south) AND floor(north)), iv AS (SELECT DISTINCT tile_lon, tile_lat FROM ({plain('dem')}))"""


def _wide(spark, d):
    return fixture(spark, d, "areas").select("area_id", (F.col("west") - 2).alias("west"), "south", (F.col("east") + 2).alias("east"), "north")


@register("j13_u05_missing_tiles", f"WITH {_COVER} SELECT DISTINCT tile_lon, tile_lat FROM cv WHERE (tile_lon, tile_lat) NOT IN (SELECT (tile_lon, tile_lat) FROM iv)")
def _(spark, d):
    return spatial.missing_tiles(_wide(spark, d), fixture(spark, d, "dem").select("tile_lon", "tile_lat").distinct())


@register("j14_any_tile", f"WITH {_COVER} SELECT DISTINCT area_id FROM cv JOIN iv USING (tile_lon, tile_lat)")
def _(spark, d):
    return spatial.boxes_with_terrain(_wide(spark, d), fixture(spark, d, "dem").select("tile_lon", "tile_lat").distinct(), ["area_id"])


@register("a20_bounds", f"{_PATH} SELECT track_id, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM pa GROUP BY 1")
def _(spark, d):
    return spatial.bounds(spatial_path(spark, d), ["track_id"])


@register("a21_content_box", f"""WITH u AS (SELECT min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM ({plain('pois')}) UNION ALL SELECT min(lon), min(lat), max(lon), max(lat) FROM ({plain('routepoints')}) UNION ALL SELECT min(west), min(south), max(east), max(north) FROM ({plain('areas')}))
SELECT min(west) AS west, min(south) AS south, max(east) AS east, max(north) AS north, round((min(west) + max(east)) / 2, 6) AS center_lon, round((min(south) + max(north)) / 2, 6) AS center_lat FROM u""")
def _(spark, d):
    areas = fixture(spark, d, "areas").agg(F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"))
    out = spatial.united(spatial.bounds(fixture(spark, d, "pois"), []), spatial.bounds(fixture(spark, d, "routepoints"), []), areas)
    return out.select("west", "south", "east", "north", r("center_lon", 6), r("center_lat", 6))


@register("p01_valid", f"WITH p AS ({plain('positions')}) SELECT fix FROM p WHERE lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90")
def _(spark, d):
    return fixture(spark, d, "positions").where(geo.valid(F.col("lon"), F.col("lat"))).select("fix")


@register("p12_p13_boxes", f"{_FEAT} SELECT area_id, count(*) FILTER (lon BETWEEN ar.west AND ar.east AND lat BETWEEN ar.south AND ar.north) AS inside, count(*) AS touching FROM ar JOIN fe ON ar.east >= fe.west AND ar.west <= fe.east AND ar.north >= fe.south AND ar.south <= fe.north GROUP BY 1")
def _(spark, d):
    return spatial.features_counted(fixture(spark, d, "areas").select("area_id", *_SIDES), fixture(spark, d, "features"), ["area_id"])


@register("p07_waypoint_elevation", f"""WITH po AS ({plain('pois')}), dm AS ({plain('dem')}), c AS (SELECT *, CAST(floor(lon) AS INT) AS tx, CAST(floor(lat) AS INT) AS ty, (lon - floor(lon)) * 20 AS x, (lat - floor(lat)) * 20 AS y FROM po),
k AS (SELECT c.*, CAST(floor(x) AS INT) AS col0, CAST(floor(y) AS INT) AS row0, dr, dc FROM c CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(dr, dc)),
h AS (SELECT wpt_id, k.ele, CASE WHEN count(z) = 4 THEN sum(z * (CASE WHEN dc = 1 THEN x - col0 ELSE 1 - (x - col0) END) * (CASE WHEN dr = 1 THEN y - row0 ELSE 1 - (y - row0) END)) END AS terrain
  FROM k LEFT JOIN dm ON dm.tile_lon = tx AND dm.tile_lat = ty AND dm.row = row0 + dr AND dm.col = col0 + dc GROUP BY 1, 2)
SELECT wpt_id, round(coalesce(terrain, ele), 4) AS elevation FROM h""")
def _(spark, d):
    from waymark.operators import terrain
    from waymark.operators.channels import elevation_of

    pois = fixture(spark, d, "pois").select("wpt_id", "ele", "lon", "lat")
    found = terrain.elevations(pois, fixture(spark, d, "dem"), ["wpt_id"])
    return pois.join(found, "wpt_id").select("wpt_id", F.round(elevation_of(F.col("ele"), F.col("elevation"), True), 4).alias("elevation"))


@register("u01_u02_distinct_hits", _CORRIDOR + f""", rp AS ({plain('routepoints')}), rb AS (SELECT DISTINCT {box_sql('lon', 'lat', 1000.0)} FROM rp),
rh AS (SELECT DISTINCT name, po.lon, po.lat FROM rb JOIN po ON po.lon BETWEEN west AND east AND po.lat BETWEEN south AND north)
SELECT name, lon, lat FROM hit UNION SELECT name, lon, lat FROM rh""")
def _(spark, d):
    pois = fixture(spark, d, "pois")
    near = spatial.near_any(spatial.densified(spatial_path(spark, d)), pois).select("name", "lon", "lat")
    also = spatial.near_any(fixture(spark, d, "routepoints").select("lon", "lat").distinct(), pois).select("name", "lon", "lat")
    return spatial.distinct_hits(near, also)


_TWO = f"WITH ar AS ({plain('areas')}), tw AS (SELECT a.area_id AS a, b.area_id AS b, a.west AS aw, a.south AS az, a.east AS ae, a.north AS an, b.west AS bw, b.south AS bz, b.east AS be, b.north AS bn FROM ar a JOIN ar b ON a.area_id + 1 = b.area_id)"


@register("u03_box_sets", f"{_TWO} SELECT a, round(least(aw, bw), 6) AS west, round(greatest(an, bn), 6) AS north, ae >= bw AND aw <= be AND an >= bz AND az <= bn AS meet, round(CASE WHEN ae >= bw AND aw <= be AND an >= bz AND az <= bn THEN greatest(aw, bw) END, 6) AS in_west FROM tw")
def _(spark, d):
    areas = fixture(spark, d, "areas")
    sides = ("west", "south", "east", "north")
    a = areas.select(F.col("area_id").alias("a"), (F.col("area_id") + 1).alias("nxt"), *[F.col(c).alias(f"a_{c}") for c in sides])
    b = areas.select(F.col("area_id").alias("nxt"), *[F.col(c).alias(f"b_{c}") for c in sides])
    one, two = geo.box_columns(tuple(f"a_{c}" for c in sides)), geo.box_columns(tuple(f"b_{c}" for c in sides))
    union, both = spatial.box_union(one, two), spatial.box_intersection(one, two)
    return a.join(b, "nxt").select("a", F.round(union["west"], 6).alias("west"), F.round(union["north"], 6).alias("north"), geo.meets(one, two).alias("meet"), F.round(both["west"], 6).alias("in_west"))


@register("u04_ranges", f"{_TWO} SELECT a, round(least(aw, bw), 6) AS low, round(greatest(ae, be), 6) AS high, round(CASE WHEN greatest(aw, bw) <= least(ae, be) THEN greatest(aw, bw) END, 6) AS in_low, round(CASE WHEN greatest(aw, bw) <= least(ae, be) THEN least(ae, be) END, 6) AS in_high FROM tw")
def _(spark, d):
    areas = fixture(spark, d, "areas")
    a = areas.select(F.col("area_id").alias("a"), (F.col("area_id") + 1).alias("nxt"), F.col("west").alias("aw"), F.col("east").alias("ae"))
    b = areas.select(F.col("area_id").alias("nxt"), F.col("west").alias("bw"), F.col("east").alias("be"))
    one, two = (F.col("aw"), F.col("ae")), (F.col("bw"), F.col("be"))
    low, high = spatial.range_union(one, two)
    in_low, in_high = spatial.range_intersection(one, two)
    return a.join(b, "nxt").select("a", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), F.round(in_low, 6).alias("in_low"), F.round(in_high, 6).alias("in_high"))


@register("u06_enabled", f"WITH po AS ({plain('pois')}) SELECT wpt_id FROM po WHERE file NOT IN (SELECT c_mktsegment FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")
def _(spark, d):
    largest = spark.read.parquet(f"{d}/customer.parquet").groupBy(F.col("c_mktsegment").alias("file")).count().orderBy(F.desc("count"), "file").limit(1)
    return spatial.enabled_only(fixture(spark, d, "pois"), largest).select("wpt_id")
