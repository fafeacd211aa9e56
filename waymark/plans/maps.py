"""Queries over map features, tiles and terrain."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import tiles as T
from waymark.operators import filters, terrain, tiles
from waymark.plans.catalog import Register
from waymark.plans.fixtures import fixture, plain
from waymark.plans.motion import r

register = Register()


def features(spark, d):
    """Features with their tags as a map; every fifth lacks a size."""
    rows = fixture(spark, d, "features")
    tags = F.map_from_entries(
        F.filter(
            F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in (("brand", F.col("brand")), ("type", F.col("type")), ("size", F.when(F.col("id") % 5 != 0, F.col("size"))))]),
            lambda e: e.v.isNotNull(),
        )
    )
    return rows.withColumn("tags", tags)


_FE = f"fe AS (SELECT *, CASE WHEN id % 5 <> 0 THEN size END AS tsize FROM ({plain('features')}))"


@register(
    "p08_attribute_filters",
    f"""WITH {_FE} SELECT id, coalesce(brand = 'Brand#3', false) AS eq, NOT coalesce(tsize = '7', false) AS ne, coalesce(CAST(tsize AS DOUBLE) > 20, false) AS gt, tsize IS NULL AS absent,
coalesce(type IN ('LARGE', 'SMALL'), false) AS among, NOT coalesce(tsize IN ('1', '2', '3'), false) AS outside, (kind = 'node' AND (coalesce(CAST(tsize AS DOUBLE) <= 10, false) OR brand = 'Brand#5')) AS nested FROM fe""",
)
def _(spark, d):
    f = lambda spec: filters.attribute_filter(spec, F.col("tags"), F.col("kind"))
    return features(spark, d).select(
        "id",
        f(["==", "brand", "Brand#3"]).alias("eq"),
        f(["!=", "size", "7"]).alias("ne"),
        f([">", "size", 20]).alias("gt"),
        f(["!has", "size"]).alias("absent"),
        f(["in", "type", "LARGE", "SMALL"]).alias("among"),
        f(["!in", "size", "1", "2", "3"]).alias("outside"),
        f(["all", ["==", "$type", "node"], ["any", ["<=", "size", 10], ["==", "brand", "Brand#5"]]]).alias("nested"),
    )


@register("p09_zoom_window", f"WITH q AS ({plain('requests')}) SELECT request, z >= 3 AND z < 7 AS fits FROM q")
def _(spark, d):
    return fixture(spark, d, "requests").select("request", filters.zoom_window(F.col("z"), 3, 7).alias("fits"))


RULES = (
    filters.Rule("big", "way", True, (0, 20), (filters.TagTest(("size",), ("10", "20", "30", "40")),)),
    filters.Rule("brand3", "any", None, (5, 14), (filters.TagTest(("brand",), ("Brand#3", "Brand#4")), filters.TagTest(("type",), ("*",)))),
    filters.Rule("no_promo", "node", None, (0, 20), (filters.TagTest(("type",), ("PROMO",), exclude=True), filters.TagTest(("size",), ("5", "6"), negated=True))),
    filters.Rule("rest", "any", None, (0, 12), (filters.TagTest(("*",), ("LARGE", "SMALL", "MEDIUM")),)),
)
_RULES = f"""{_FE}, ru AS (SELECT id, 0 AS priority, 'big' AS rule FROM fe WHERE kind = 'way' AND closed AND tsize IS NOT NULL AND tsize IN ('10', '20', '30', '40')
UNION ALL SELECT id, 1, 'brand3' FROM fe WHERE brand IN ('Brand#3', 'Brand#4')
UNION ALL SELECT id, 2, 'no_promo' FROM fe WHERE kind = 'node' AND type <> 'PROMO' AND (tsize IS NULL OR tsize IN ('5', '6'))
UNION ALL SELECT id, 3, 'rest' FROM fe WHERE type IN ('LARGE', 'SMALL', 'MEDIUM'))"""


@register("p10_j19_all_rules", f"WITH {_RULES} SELECT id, priority, rule FROM ru")
def _(spark, d):
    return filters.all_matches(features(spark, d), RULES, 10)


@register("j18_first_rule", f"WITH {_RULES} SELECT id, arg_min(rule, priority) AS rule FROM ru GROUP BY 1")
def _(spark, d):
    return filters.first_match(features(spark, d), RULES, 10)


LAYERS = {
    "hiking": {"categories": ["0", "1"], "parent": "base", "overlays": ["huts", "bikes"]},
    "base": {"categories": ["2"]},
    "huts": {"categories": ["4"], "enabled": True},
    "bikes": {"categories": ["3"], "enabled": False},
}


@register("p11_visible_layers", f"WITH {_FE} SELECT id FROM fe WHERE layer IN (0, 1, 2, 4)")
def _(spark, d):
    return features(spark, d).where(F.col("layer").cast("string").isin(filters.visible_categories(LAYERS, "hiking"))).select("id")


@register("p14_usage_bands", "SELECT o_orderkey, CAST(z AS INT) AS z, CASE o_orderkey % 8 WHEN 1 THEN z BETWEEN 6 AND 7 WHEN 2 THEN z BETWEEN 8 AND 9 WHEN 3 THEN z BETWEEN 10 AND 11 WHEN 4 THEN z BETWEEN 12 AND 13 WHEN 5 THEN z BETWEEN 14 AND 18 WHEN 6 THEN z = 19 ELSE false END AS shown FROM (SELECT o_orderkey, 5 + o_custkey % 16 AS z FROM orders)")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", (5 + F.col("o_custkey") % 16).cast("int").alias("z"))
    band = filters.usage_zooms(F.col("o_orderkey") % 8)
    return rows.select("o_orderkey", "z", F.coalesce(F.col("z").between(band["low"], band["high"]), F.lit(False)).alias("shown"))


@register("p15_schema", "SELECT p_brand, bool_or(p_type = 'PROMO') AND bool_or(p_type = 'LARGE') AS covers FROM part GROUP BY 1")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").groupBy("p_brand").agg(F.collect_set("p_type").alias("layers"))
    return rows.select("p_brand", filters.covers_schema(F.array(F.lit("PROMO"), F.lit("LARGE")), F.col("layers")).alias("covers"))


_TI, _RQ = f"ti AS ({plain('tiles')})", f"rq AS ({plain('requests')})"


@register("j15_tile_lookup", f"WITH {_TI}, {_RQ} SELECT request, payload FROM rq LEFT JOIN ti USING (z, x, y)")
def _(spark, d):
    return tiles.tile_lookup(fixture(spark, d, "requests"), fixture(spark, d, "tiles")).select("request", "payload")


@register("j15_tms_lookup", f"WITH {_TI}, {_RQ} SELECT request, payload FROM rq LEFT JOIN ti ON rq.z = ti.z AND rq.x = ti.x AND ti.y = CAST(pow(2, rq.z) AS BIGINT) - rq.y - 1")
def _(spark, d):
    return tiles.tile_lookup(fixture(spark, d, "requests"), fixture(spark, d, "tiles"), "tms").select("request", "payload")


@register("j15_inverted_lookup", f"WITH {_TI}, {_RQ} SELECT request, payload FROM rq LEFT JOIN ti ON 17 - rq.z = ti.z + 9 AND rq.x = ti.x AND rq.y = ti.y")
def _(spark, d):
    stored = fixture(spark, d, "tiles").withColumn("z", F.col("z") + 9)
    return tiles.tile_lookup(fixture(spark, d, "requests"), stored, "inverted").select("request", "payload")


@register("j15_packed_lookup", f"WITH {_TI}, {_RQ} SELECT request, payload FROM rq LEFT JOIN ti USING (z, x, y)")
def _(spark, d):
    stored = fixture(spark, d, "tiles").select(T.packed_key(F.col("x"), F.col("y"), F.col("z")).alias("key"), "payload")
    return tiles.tile_lookup(fixture(spark, d, "requests"), stored, "packed").select("request", "payload")


@register("j16_overzoom", f"WITH {_TI}, {_RQ} SELECT request, greatest(rq.z - 5, 0) AS overzoom, payload FROM rq LEFT JOIN ti ON least(rq.z, 5) = ti.z AND rq.x // CAST(pow(2, greatest(rq.z - 5, 0)) AS BIGINT) = ti.x AND rq.y // CAST(pow(2, greatest(rq.z - 5, 0)) AS BIGINT) = ti.y")
def _(spark, d):
    return tiles.overzoomed(fixture(spark, d, "requests"), fixture(spark, d, "tiles"), 5).select("request", "overzoom", "payload")


@register("j17_directory", f"""WITH dr AS (SELECT o_orderkey * 1000003 AS tile_id, CASE WHEN o_custkey % 11 = 0 THEN 0 ELSE (o_custkey * 7919) % 1500000 END AS run_length, o_orderkey AS off FROM orders WHERE o_orderkey % 10 = 0),
pr AS (SELECT o_orderkey AS request, o_orderkey * 999983 + o_custkey * 31 AS id FROM orders)
SELECT request, CASE WHEN run_length = 0 OR id - tile_id < greatest(run_length, 1) THEN off END AS run FROM pr ASOF LEFT JOIN dr ON pr.id >= dr.tile_id""")
def _(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    run = F.when(F.col("o_custkey") % 11 == 0, 0).otherwise((F.col("o_custkey") * 7919) % 1500000)
    directory = orders.where("o_orderkey % 10 = 0").select((F.col("o_orderkey") * 1000003).alias("tile_id"), run.alias("run_length"), F.col("o_orderkey").alias("offset"))
    ids = orders.select(F.col("o_orderkey").alias("request"), (F.col("o_orderkey") * 999983 + F.col("o_custkey") * 31).alias("id"))
    return tiles.directory_lookup(ids, directory).select("request", F.col("offset").alias("run"))


@register("a25_covered", f"""WITH {_TI}, b AS (SELECT z, min(x) AS x0, max(x) + 1 AS x1, min(y) AS y0, max(y) + 1 AS y1 FROM ti WHERE z = (SELECT min(z) FROM ti) GROUP BY z)
SELECT z, round(x0 * 360 / pow(2, z) - 180, 6) AS west, round(degrees(2 * atan(exp(radians(180 - y1 * 360 / pow(2, z)))) - pi() / 2), 6) AS south, round(x1 * 360 / pow(2, z) - 180, 6) AS east, round(degrees(2 * atan(exp(radians(180 - y0 * 360 / pow(2, z)))) - pi() / 2), 6) AS north FROM b""")
def _(spark, d):
    return tiles.covered(fixture(spark, d, "tiles")).select("z", r("west", 6), r("south", 6), r("east", 6), r("north", 6))


@register("a26_zooms", f"WITH {_TI} SELECT DISTINCT z FROM ti")
def _(spark, d):
    return tiles.zooms_present(fixture(spark, d, "tiles"))


@register("t05_best_zoom", f"WITH {_TI} SELECT max(z) AS z FROM ti WHERE z <= 5")
def _(spark, d):
    return tiles.best_zoom(fixture(spark, d, "tiles"), 5)


@register("a27_terrain_catalog", f"WITH dm AS (SELECT tile_lon, tile_lat, count(*) AS length FROM ({plain('dem')}) GROUP BY 1, 2) SELECT tile_lon, tile_lat, printf('N%02dE%03d.hgt', tile_lat, tile_lon) AS file, round(length / 1048576e0, 1) AS size_mb FROM dm")
def _(spark, d):
    files = fixture(spark, d, "dem").groupBy("tile_lon", "tile_lat").agg(F.count("*").alias("length")).select(T.degree_tile_name(F.col("tile_lon"), F.col("tile_lat")).alias("file"), "length")
    return tiles.terrain_catalog(files)


@register("a28_source_layers", "SELECT DISTINCT p_type AS source_layer FROM part WHERE p_size > 3")
def _(spark, d):
    return tiles.source_layers(spark.read.parquet(f"{d}/part.parquet").select(F.when(F.col("p_size") > 3, F.col("p_type")).alias("source_layer")))


@register("w22_tiers", "WITH m AS (SELECT p_brand AS atlas, p_partkey AS name, p_retailprice * (1 + p_size) AS resolution FROM part), s AS (SELECT *, lag(resolution) OVER (PARTITION BY atlas ORDER BY resolution DESC, name) AS before FROM m) SELECT atlas, name, CAST(sum(CASE WHEN resolution < before * 0.8e0 THEN 1 ELSE 0 END) OVER (PARTITION BY atlas ORDER BY resolution DESC, name) AS BIGINT) AS tier FROM s")
def _(spark, d):
    maps = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("atlas"), F.col("p_partkey").alias("name"), (F.col("p_retailprice") * (1 + F.col("p_size"))).alias("resolution"))
    return tiles.resolution_tiers(maps).select("atlas", "name", "tier")


@register("t01_t02_draw_order", f"WITH {_FE} SELECT id, CAST(row_number() OVER (PARTITION BY layer ORDER BY CAST(size AS INT) DESC, id) AS INT) AS place FROM fe")
def _(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("layer").orderBy(F.desc(F.col("size").cast("int")), "id")
    return fixture(spark, d, "features").select("id", F.row_number().over(order).alias("place"))


@register("t04_labels", f"WITH {_FE} SELECT title, arg_min(id, (-CAST(size AS INT), id)) AS id FROM fe GROUP BY 1")
def _(spark, d):
    return filters.one_label_each(fixture(spark, d, "features"), "title", [F.desc(F.col("size").cast("int")), F.col("id")]).select("title", "id")


@register("t06_tile_limit", f"WITH dm AS ({plain('dem')}) SELECT count(*) > 3 AS over_limit FROM (SELECT DISTINCT tile_lon, tile_lat FROM dm)")
def _(spark, d):
    need = fixture(spark, d, "dem").select("tile_lon", "tile_lat").distinct().limit(3 + 1)
    return need.agg((F.count("*") > 3).alias("over_limit"))


@register("t07_most_used", "SELECT l_returnflag, arg_min(q, (-n, q)) AS top FROM (SELECT l_returnflag, l_quantity AS q, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def _(spark, d):
    counts = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_returnflag", F.col("l_quantity").alias("q")).count()
    return counts.groupBy("l_returnflag").agg(F.min_by("q", F.struct(-F.col("count"), "q")).alias("top"))


_SHADE = f"""dm AS ({plain('dem')}), n AS (SELECT tile_lon, tile_lat, samples, row, col, z, lag(z) OVER a AS l, lead(z) OVER a AS r FROM dm WINDOW a AS (PARTITION BY tile_lon, tile_lat, row ORDER BY col)),
n2 AS (SELECT *, lead(z) OVER b AS nz, lead(l) OVER b AS nl, lead(r) OVER b AS nr, lag(z) OVER b AS sz, lag(l) OVER b AS sl, lag(r) OVER b AS sr FROM n WINDOW b AS (PARTITION BY tile_lon, tile_lat, col ORDER BY row)),
dv AS (SELECT *, 0.6e0 * (nr + 2 * r + sr - nl - 2 * l - sl) / 8 AS dx, 0.6e0 * (nl + 2 * nz + nr - sl - 2 * sz - sr) / 8 AS dy FROM n2 WHERE row BETWEEN 1 AND samples - 2 AND col BETWEEN 1 AND samples - 2),
li AS (SELECT *, (sin(radians(45)) - cos(radians(45)) * sin(radians(315)) * dx - cos(radians(45)) * cos(radians(315)) * dy) / sqrt(1 + dx * dx + dy * dy) * 0.8e0 + 0.2e0 AS lit FROM dv)"""


@register("w19_hill_shade", f"WITH {_SHADE} SELECT tile_lon, tile_lat, row, col, round(CASE WHEN lit >= 0 THEN sqrt(lit) WHEN lit < 0 THEN 0e0 END, 5) AS light FROM li")
def _(spark, d):
    return terrain.hill_shade(fixture(spark, d, "dem")).select("tile_lon", "tile_lat", "row", "col", r("light", 5))


def _blur_sql(radius: int) -> str:
    out = [f"b0 AS (SELECT tile_lon, tile_lat, row, col, coalesce(CAST(z AS DOUBLE), 0e0) AS s, CASE WHEN z IS NULL THEN 0e0 ELSE 1e0 END AS w, z IS NULL AS gone FROM ({plain('dem')}))"]
    k = 0
    for size in terrain.box_sizes(radius):
        h = (size - 1) // 2
        for along, across in (("col", "row"), ("row", "col")):
            part = f"PARTITION BY tile_lon, tile_lat, {across}"
            cols = []
            for v in ("s", "w"):
                inside = f"sum({v}) OVER ({part} ORDER BY {along} ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)"
                first, last = f"first({v}) OVER ({part} ORDER BY {along})", f"last({v}) OVER ({part} ORDER BY {along} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
                i, n = f"(row_number() OVER ({part} ORDER BY {along}) - 1)", f"count(*) OVER ({part})"
                cols.append(f"({inside} + greatest({h} - {i}, 0) * {first} + greatest({i} + {h} - {n} + 1, 0) * {last}) / {2 * h + 1}e0 AS {v}")
            out.append(f"b{k + 1} AS (SELECT tile_lon, tile_lat, row, col, gone, {', '.join(cols)} FROM b{k})")
            k += 1
    return f"WITH {', '.join(out)} SELECT tile_lon, tile_lat, row, col, round(CASE WHEN NOT gone AND w <> 0 THEN s / w END, 5) AS z FROM b{k}"


@register("w20_blur", _blur_sql(3))
def _(spark, d):
    return terrain.blurred(fixture(spark, d, "dem"), 3).select("tile_lon", "tile_lat", "row", "col", r("z", 5))


@register("h12_tiles", f"""WITH po AS ({plain('pois')}), m AS (SELECT wpt_id, CAST(1 + wpt_id % 18 AS INT) AS z, lon AS mx, degrees(ln(tan(radians(45 + lat / 2)))) AS my FROM po)
SELECT wpt_id, z, CAST(least(floor((mx + 180) / 360 * pow(2, z)), pow(2, z) - 1) AS BIGINT) AS x, CAST(least(floor((180 - my) / 360 * pow(2, z)), pow(2, z) - 1) AS BIGINT) AS y FROM m""")
def _(spark, d):
    rows = fixture(spark, d, "pois").withColumn("z", (1 + F.col("wpt_id") % 18).cast("int"))
    x, y = T.tile_of(*T.to_mercator(F.col("lon"), F.col("lat")), F.col("z"))
    return rows.select("wpt_id", "z", x.alias("x"), y.alias("y"))


@register("h13_scales", f"WITH po AS ({plain('pois')}), s AS (SELECT wpt_id, lat, 360 / (pow(2, 1 + wpt_id % 18) * 256) AS scale FROM po) SELECT wpt_id, round(scale, 9) AS scale, CAST(floor(log2(360 / (scale * 256)) + 1e-6) AS INT) AS zoom, round(radians(1) * 6378137 * scale * cos(radians(lat)), 4) AS resolution FROM s")
def _(spark, d):
    scale = T.zoom_to_scale(1 + F.col("wpt_id") % 18)
    return fixture(spark, d, "pois").select("wpt_id", F.round(scale, 9).alias("scale"), T.scale_to_zoom(scale).alias("zoom"), F.round(T.ground_resolution(F.col("lat"), scale), 4).alias("resolution"))


@register("h14_quadkeys", f"WITH {_RQ} SELECT request, array_to_string(list_transform(range(z - 1, -1, -1), lambda b: CAST(((x >> b) & 1) + 2 * ((y >> b) & 1) AS VARCHAR)), '') AS quadkey FROM rq")
def _(spark, d):
    return fixture(spark, d, "requests").select("request", T.quadkey(F.col("x"), F.col("y"), F.col("z")).alias("quadkey"))


@register("h14_hilbert_ids", f"""WITH RECURSIVE {_RQ}, hb AS (SELECT request, z - 1 AS a, x, y, CAST((pow(4, z) - 1) / 3 AS BIGINT) AS acc FROM rq
UNION ALL SELECT request, a - 1, CASE WHEN (y >> a) & 1 = 1 THEN x WHEN (x >> a) & 1 = 1 THEN (CAST(1 AS BIGINT) << a) - 1 - (y & ((CAST(1 AS BIGINT) << a) - 1)) ELSE y END,
CASE WHEN (y >> a) & 1 = 1 THEN y WHEN (x >> a) & 1 = 1 THEN (CAST(1 AS BIGINT) << a) - 1 - (x & ((CAST(1 AS BIGINT) << a) - 1)) ELSE x END,
acc + (CAST(1 AS BIGINT) << (2 * a)) * (CASE WHEN (x >> a) & 1 = 1 THEN CASE WHEN (y >> a) & 1 = 1 THEN 2 ELSE 3 END ELSE (y >> a) & 1 END) FROM hb WHERE a >= 0)
SELECT request, acc AS tile_id FROM hb WHERE a = -1""")
def _(spark, d):
    return fixture(spark, d, "requests").select("request", T.hilbert_id(F.col("x"), F.col("y"), F.col("z")).alias("tile_id"))


@register("h15_degree_tiles", f"""WITH ar AS (SELECT area_id, CASE WHEN west > east THEN west ELSE west - 16 END AS west, east, south, north FROM ({plain('areas')}))
SELECT area_id, CAST(x AS INT) AS tile_lon, CAST(y AS INT) AS tile_lat, 'N' || lpad(CAST(y AS VARCHAR), 2, '0') || CASE WHEN x < 0 THEN 'W' ELSE 'E' END || lpad(CAST(abs(x) AS VARCHAR), 3, '0') || '.hgt' AS name
FROM ar, range(-180, 180) a(x), range(-90, 91) b(y) WHERE CASE WHEN west > east THEN x >= floor(west) OR x <= floor(east) ELSE x BETWEEN floor(west) AND floor(east) END AND y BETWEEN floor(south) AND floor(north)""")
def _(spark, d):
    west = F.when(F.col("west") > F.col("east"), F.col("west")).otherwise(F.col("west") - 16)
    n = fixture(spark, d, "areas").select("area_id", F.explode(T.degree_tiles(west, F.col("south"), F.col("east"), F.col("north"))).alias("n")).select("area_id", "n.*")
    return n.select("*", T.degree_tile_name(F.col("tile_lon"), F.col("tile_lat")).alias("name"))


@register("h23_zoom_functions", f"WITH {_RQ} SELECT request, round(CASE WHEN z <= 2 THEN 1e0 WHEN z < 6 THEN 1 + (pow(1.5, z - 2) - 1) / (pow(1.5, 4) - 1) * 4 WHEN z < 8 THEN 5 + (pow(1.5, z - 6) - 1) / (pow(1.5, 2) - 1) * 15 ELSE 20e0 END, 6) AS width, round(CASE WHEN z <= 2 THEN 1e0 WHEN z < 6 THEN z - 1 WHEN z < 8 THEN 5 + (z - 6) / 2e0 * 15 ELSE 20e0 END, 6) AS even, CASE WHEN z >= 7 THEN 'c' WHEN z >= 4 THEN 'b' ELSE 'a' END AS step FROM rq")
def _(spark, d):
    stops = [(2, 1.0), (6, 5.0), (8, 20.0)]
    z = F.col("z")
    return fixture(spark, d, "requests").select(
        "request", F.round(filters.zoom_function(stops, z, 1.5), 6).alias("width"), F.round(filters.zoom_function(stops, z), 6).alias("even"), filters.zoom_steps([(1, "a"), (4, "b"), (7, "c")], z).alias("step")
    )


@register("h29_stroke_scale", f"WITH {_RQ} SELECT request, round(CASE WHEN z + 8 >= 12 THEN pow(1.5, z + 8 - 12) ELSE 1e0 END, 6) AS scale FROM rq")
def _(spark, d):
    return fixture(spark, d, "requests").select("request", F.round(filters.stroke_scale(F.col("z") + 8), 6).alias("scale"))


@register("s29_features_by_zoom", f"WITH {_TI} SELECT z, count(*) AS tiles, CAST(sum(payload) AS BIGINT) AS payloads FROM ti WHERE z BETWEEN 2 AND 4 GROUP BY 1")
def _(spark, d):
    return fixture(spark, d, "tiles").where("z between 2 and 4").groupBy("z").agg(F.count("*").alias("tiles"), F.sum("payload").alias("payloads"))
