"""Boxes, great circles, joins, tiles, rules and projections on cases computed by hand."""

import math
import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from waymark.functions import geo, projection, texts, tiles, units
from waymark.operators import filters, lookup, spatial, terrain


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def lits(*values):
    return [F.lit(float(v)) for v in values]


def test_boxes_at_the_date_line_and_pole(spark):
    box = geo.box_around(*lits(179.99, 0), 5000.0)
    west, east = one(spark, box["west"], box["east"])
    assert west > 179 and east < -179
    parts = one(spark, geo.split_at_date_line(box["west"], box["south"], box["east"], box["north"]))[0]
    assert [(p.west > 0, p.east) for p in parts] == [(True, 180.0), (False, pytest.approx(east))]
    polar = geo.box_around(*lits(10, 89.99), 5000.0)
    assert one(spark, polar["west"], polar["east"], polar["north"]) == (-180.0, 180.0, 90.0)
    assert one(spark, geo.box_width(*lits(170, -170))) == (360 - 340,)
    assert one(spark, geo.wrapped(F.lit(190.0)), geo.wrapped(F.lit(-190.0))) == (-170.0, 170.0)


def test_great_circle_ends_and_antipodes(spark):
    for part, want in ((0.0, (10, 20)), (1.0, (40, 50))):
        assert one(spark, *geo.great_circle(*lits(10, 20, 40, 50), F.lit(part))) == pytest.approx(want)
    assert one(spark, *geo.great_circle(*lits(10, 20, 10, 20), F.lit(0.3))) == (10, 20)
    lon, lat = one(spark, *geo.great_circle(*lits(0, 0, 180, 0), F.lit(0.5)))
    assert not math.isnan(lon) and not math.isnan(lat)


def test_grid_join_is_the_brute_force_join(spark):
    rng = random.Random(1)
    boxes = []
    for i in range(40):
        w, s = rng.uniform(-180, 180), rng.uniform(-80, 80)
        e = w + rng.choice([0.01, 0.5, 20, 200])
        boxes.append((i, w, s, e - 360 if e > 180 else e, min(90.0, s + rng.choice([0.01, 3, 40]))))
    pts = [(i, rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(400)] + [(900, boxes[0][1], boxes[0][2])]
    want = {(b, p) for b, w, s, e, n in boxes for p, x, y in pts if s <= y <= n and (w <= x <= e if w <= e else x >= w or x <= e)}
    out = spatial.boxes_with_points(spark.createDataFrame(boxes, "box long, west double, south double, east double, north double"), spark.createDataFrame(pts, "pt long, lon double, lat double"))
    got = [(r.box, r.pt) for r in out.select("box", "pt").collect()]
    assert set(got) == want and len(got) == len(want)


def test_next_sample(spark):
    p = spark.createDataFrame([("f", 1, 10), ("f", 2, 20), ("f", 3, 31), ("g", 1, 5)], "k string, n int, t int")
    s = spark.createDataFrame([("f", 10, 0, 1.0), ("f", 10, 1, 2.0), ("f", 30, 2, 3.0)], "k string, t int, nth int, hr double")
    got = {(r.k, r.n): r.hr for r in lookup.next_sample(p, s, ["k"], "t", ["hr"]).collect()}
    assert got == {("f", 1): 2.0, ("f", 2): 3.0, ("f", 3): None, ("g", 1): None}


def test_tiles(spark):
    assert one(spark, *tiles.tile_of(*lits(0, 0), F.lit(0))) == (0, 0)
    assert one(spark, *tiles.tile_of(*lits(180, -180), F.lit(3))) == (7, 7)
    for z in (1, 5, 12):
        x, y = 2**z - 1, 2**z // 3
        corner = tiles.tile_corner(F.lit(x), F.lit(y), F.lit(z))
        half = 180.0 / 2**z
        assert one(spark, *tiles.tile_of(corner[0] + half, corner[1] - half, F.lit(z))) == (x, y)
    assert one(spark, tiles.flipped_row(F.lit(1), F.lit(3)), tiles.packed_key(F.lit(3), F.lit(5), F.lit(3))) == (6, ((3 << 3) + 3 << 3) + 5)
    assert one(spark, tiles.quadkey(F.lit(3).cast("long"), F.lit(5).cast("long"), F.lit(3)), tiles.quadkey(F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0))) == ("213", "")
    ids = spark.range(64).selectExpr("id % 8 AS x", "id div 8 AS y").select(tiles.hilbert_id(F.col("x"), F.col("y"), F.lit(3)).alias("h")).collect()
    assert sorted(r.h for r in ids) == list(range(21, 85))
    assert one(spark, tiles.degree_tile_name(*lits(-3, -1))) == ("S01W003.hgt",)


def test_attribute_filter_truth_table(spark):
    df = spark.createDataFrame([({"a": "x", "n": "5"},), ({},)], "tags map<string,string>")
    specs = [["==", "a", "x"], ["!=", "a", "x"], ["<", "n", 6], [">=", "n", 6], ["in", "a", "x", "y"], ["!in", "a", "x"], ["has", "a"], ["!has", "a"], ["all"], ["any"], ["all", ["has", "a"], ["any", ["==", "n", 5], ["has", "z"]]]]
    got = [tuple(r) for r in df.select(*[filters.attribute_filter(s, df.tags).alias(f"c{i}") for i, s in enumerate(specs)]).collect()]
    assert got[0] == (True, False, True, False, True, False, True, False, True, False, True)
    assert got[1] == (False, True, False, False, False, True, False, True, True, False, False)


def test_tag_tests_match_over_different_tags(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"},)], "tags map<string,string>")
    t = filters.TagTest
    tests = [t(("a",), ("2",)), t(("c",), ("2",)), t(("a",), ("1",), exclude=True), t(("c",), ("9",), negated=True), t(("a",), ("9",), negated=True), t(("*",), ("*",))]
    assert tuple(df.select(*[x.matches(df.tags).alias(f"c{i}") for i, x in enumerate(tests)]).first()) == (True, False, False, True, False, True)


def test_zoom_functions(spark):
    stops = [(5, 1.0), (10, 2.0)]
    assert one(spark, filters.zoom_function(stops, F.lit(4)), filters.zoom_function(stops, F.lit(7.5)), filters.zoom_function(stops, F.lit(11))) == (1.0, 1.5, 2.0)
    assert one(spark, filters.zoom_window(F.lit(-1), 3, 5), filters.zoom_window(F.lit(5), 3, 5)) == (True, False)


def test_projections_there_and_back(spark):
    for lon, lat in ((14.4, 50.1), (-70.7, -33.4), (5.3, 60.4), (12, 78)):
        zone, x, y = projection.utm(*lits(lon, lat))
        assert one(spark, *projection.from_utm(zone, x, y)) == pytest.approx((lon, lat), abs=1e-6)
        assert one(spark, *projection.from_web_mercator(*projection.web_mercator(*lits(lon, lat)))) == pytest.approx((lon, lat), abs=1e-9)
    assert one(spark, projection.utm_zone(*lits(5.3, 60.4)), projection.utm_zone(*lits(12, 78)), projection.utm_zone(*lits(-70.7, -33.4))) == (32, 33, -19)
    _, x, y = projection.utm(*lits(15, 0))
    assert one(spark, x, y) == pytest.approx((500000, 0), abs=1e-6)
    p = {k: F.lit(v) for k, v in zip(("radius", "inverse_flattening", "dx", "dy", "dz", "rx", "ry", "rz", "ds"), (6377397.155, 299.1528128, 598.1, 73.7, 418.2, 0.2, 0.04, -2.4, 6.7), strict=True)}
    xyz = projection.helmert_back(*projection.helmert(*projection.to_geocentric(*lits(14, 50), p["radius"], p["inverse_flattening"]), p), p)
    assert one(spark, *projection.from_geocentric(*xyz, p["radius"], p["inverse_flattening"])) == pytest.approx((14, 50), abs=1e-6)


def test_texts(spark):
    assert one(spark, units.time_span_text(F.lit(3725.9)), units.time_span_text(F.lit(65.0))) == ("01:02:05", "01:05")
    assert one(spark, units.distance_text(F.lit(999.0)), units.distance_text(F.lit(1500.0)), units.distance_text(F.lit(15000.0), "imperial")) == ("999 m", "1.50 km", "9.32 mi")
    assert one(spark, units.degrees_minutes_seconds_text(*lits(-14.5, 50.25))) == ("50° 15' 00.0\"N, 14° 30' 00.0\"W",)
    assert one(spark, texts.nmea_angle(F.lit("5030.00"), F.lit("S")), texts.nmea_angle(F.lit("50x0"), F.lit("N")), texts.cup_angle(F.lit("01430.000W")), texts.igc_angle(F.lit("5030000N"))) == (-50.5, None, -14.5, 50.5)
    assert one(spark, units.nice_number(F.lit(0.03)), units.nice_number(F.lit(170.0), True)) == pytest.approx((0.05, 200.0))


def test_halo_gives_rims_their_neighbours(spark):
    rows = [(t, 50, 3, r, c, t * 100 + r * 10 + c) for t in (14, 15) for r in range(3) for c in range(3)]
    dem = spark.createDataFrame(rows, "tile_lon int, tile_lat int, samples int, row int, col int, z int")
    rim = {(r.tile_lon, r.row, r.col): r.z for r in terrain.with_halo(dem).collect()}
    assert rim[(14, 1, 3)] == 1500 + 11 and rim[(15, 2, -1)] == 1400 + 21
    assert terrain.box_sizes(3) == [5, 5, 7]


def test_next_sample_is_linear_in_a_long_track(spark):
    import time

    from pyspark.sql import functions as F

    from waymark.operators import lookup

    points = spark.range(40_000).select(F.lit(1).alias("k"), (F.col("id") * 2).alias("ts"), "id")
    samples = spark.range(40_000).select(F.lit(1).alias("k"), (F.col("id") * 2 + 1).alias("ts"), F.col("id").alias("nth"), (F.col("id") * 10).alias("v"))
    start = time.time()
    found = lookup.next_sample(points, samples, ["k"], "ts", ["v"])
    assert found.where("v <> id * 10 or v is null").count() == 0 and time.time() - start < 30


def test_tiles_and_boxes_over_the_date_line(spark):
    from pyspark.sql import functions as F

    from waymark.functions import tiles
    from waymark.operators import spatial

    box = spark.createDataFrame([(1, 179.5, 10.2, -179.5, 10.4)], "area long, west double, south double, east double, north double")
    cover = tiles.degree_tiles(*map(F.col, ("west", "south", "east", "north")))
    assert sorted(tuple(t) for t in box.select(F.explode(cover).alias("t")).select("t.*").collect()) == [(-180, 10), (179, 10)]
    others = spark.createDataFrame([(1, 179.9, 10.0, 180.0, 10.3), (2, -180.0, 10.3, -179.9, 10.9), (3, 0.0, 10.0, 1.0, 11.0), (4, 179.0, -80.0, -179.0, 80.0), (5, -180.0, -90.0, 180.0, 90.0)], "id long, west double, south double, east double, north double")
    assert sorted(r.id for r in spatial.boxes_with_boxes(box, others).select("id").distinct().collect()) == [1, 2, 4, 5]
    points = spark.createDataFrame([(1, 179.9, 10.3), (2, -179.9, 10.3), (3, 0.0, 10.3), (4, 180.0, 10.3)], "id long, lon double, lat double")
    assert sorted(r.id for r in spatial.boxes_with_points(box, points).collect()) == [1, 2, 4]
    everywhere = others.where("id = 5").select(F.lit(9).alias("area"), "west", "south", "east", "north")
    assert spatial.boxes_with_points(everywhere, points).count() == 4


def test_directory_runs_and_leaves(spark):
    from waymark.operators import tiles

    entries = spark.createDataFrame([(5, 3, 50), (1 << 20, 0, 60), (1 << 45, 1 << 30, 70)], "tile_id long, run_length long, offset long")
    ids = [0, 5, 7, 8, (1 << 20) - 1, 1 << 20, (1 << 33) + 5, (1 << 45) - 1, (1 << 45) + 12345, (1 << 45) + (1 << 30), 1 << 60]
    want = [None, 50, 50, None, None, 60, 60, 60, 70, None, None]
    got = {r.id: r.offset for r in tiles.directory_lookup(spark.createDataFrame([(i,) for i in ids], "id long"), entries).collect()}
    assert [got[i] for i in ids] == want


def test_interpolation_without_bins(spark):
    """An interval of 10^15, ends that touch, repeated distances, probes outside and in gaps; no interval is spread."""
    points = [(1, 0, 0, 0.0, 0.0), (1, 0, 1, 1e15, 10.0), (1, 1, 0, 1e15, 50.0), (1, 1, 1, 1e15, 60.0), (1, 1, 2, 2e15, 70.0), (1, 2, 0, 3e15, 0.0), (1, 3, 0, 4e15, 1.0), (1, 3, 1, 5e15, 2.0), (2, 0, 0, 1.0, 8.0), (2, 0, 1, 1.0, 6.0), (2, 0, 2, 3.0, 10.0)]
    series = spark.createDataFrame(points, "track_id long, seg_no int, g_no int, x double, y double")
    asked = [(1, -1.0), (1, 0.0), (1, 5e14), (1, 1e15), (1, 1.5e15), (1, 2.5e15), (1, 3e15), (1, 4.5e15), (1, 6e15), (2, 1.0), (2, 2.0), (3, 1.0), (1, 5e14), (1, None)]
    probes = spark.createDataFrame([(*a, i) for i, a in enumerate(asked)], "track_id long, at double, n int")
    out = lookup.interpolated(probes, series, ["track_id"], "x", "y", with_segment=True)
    got = {r.n: (r.y, r.seg_no) for r in out.collect()}
    none = (None, None)
    assert got == {0: none, 1: (0, 0), 2: (5, 0), 3: (10, 0), 4: (65, 1), 5: none, 6: none, 7: (1.5, 3), 8: none, 9: (6, 0), 10: (8, 0), 11: none, 12: (5, 0), 13: none}
    assert "sequence(" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_interpolation_against_all_intervals(spark):
    rng = random.Random(6)
    points = []
    for track in range(8):
        x = 0.0
        for seg in range(3):
            for g in range(rng.randrange(1, 8)):
                x += rng.choice([0.0, 0.0, 1.0, 2.5, 1e6])
                points.append((track, seg, g, x, float(rng.randrange(5))))
    series = spark.createDataFrame(points, "track_id long, seg_no int, g_no int, x double, y double")
    asked = sorted({(t, x + d) for t, _, _, x, _ in points for d in (-0.5, 0.0, 0.25)})
    got = {(r.track_id, r.at): r.y for r in lookup.interpolated(spark.createDataFrame(asked, "track_id long, at double"), series, ["track_id"], "x", "y").collect()}
    for track, at in asked:
        spans = [(a[1], a[3], a[4] + ((at - a[3]) / (b[3] - a[3]) if b[3] > a[3] else 0.0) * (b[4] - a[4])) for a, b in zip(points, points[1:]) if a[0] == b[0] == track and a[1] == b[1] and a[3] <= at <= b[3]]
        assert got[track, at] == (min(spans)[2] if spans else None)


def test_positions_are_those_of_markers(spark):
    rows = [(1, 0, 0, 14.0, 50.0, 0.0), (1, 0, 1, 14.1, 50.0, 7000.0), (1, 0, 2, 14.1, 50.001, 7100.0), (1, 1, 0, 14.2, 50.1, 7100.0), (1, 1, 1, 14.21, 50.1, 7900.0)]
    path = spark.createDataFrame(rows, "track_id long, seg_no int, pt_no int, lon double, lat double, dist double")
    want = {r.at: (r.lon, r.lat) for r in lookup.distance_markers(path, 500.0).collect()}
    probes = spark.createDataFrame([(1, 500.0 * k) for k in range(1, 16)] + [(1, 1e9), (9, 1.0)], "track_id long, at double")
    out = lookup.position_at(probes, path)
    got = {(r.track_id, r.at): (r.lon, r.lat) for r in out.collect()}
    assert got.pop((1, 1e9)) == got.pop((9, 1.0)) == (None, None)
    assert {at: p for (_, at), p in got.items()} == want and len(want) == 15
    assert "sequence(" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("spot", [True, False])
def test_a_crowded_cell_is_dealt_to_many_tasks(spark, spot):
    """Nine tenths of the points in one cell, or in one place: no part holds over a twentieth of all, and nothing is lost."""
    n, rng = 4000, random.Random(2)
    near = lambda: (14.005, 50.005) if spot else (14 + rng.random() * 0.02, 50 + rng.random() * 0.02)
    rows = [(i, *(near() if i % 10 else (rng.uniform(13, 15), rng.uniform(49, 51)))) for i in range(n)]
    points = spark.createDataFrame(rows, "wpt_id long, lon double, lat double")
    boxes = [(k, west, south, west + w, south + w) for k, (west, south, w) in enumerate([(14.0, 50.0, 0.006), (13.99, 49.99, 0.03), (13.0, 49.0, 2.0), (-170.0, -80.0, 160.0)])]
    crowded = spatial.crowded_cells(points, "lon", "lat", [0, 1, 2], most=100)
    parts = spatial.in_parts(points, crowded, "lon", "lat", [0, 1, 2]).groupBy("grid", "cell", "cell_part").count()
    assert parts.agg(F.max("count")).first()[0] < n / 20
    frame = spark.createDataFrame(boxes, "box long, west double, south double, east double, north double")
    got = sorted((r.box, r.wpt_id) for r in spatial.boxes_with_points(frame, points, most=100).collect())
    want = sorted((b, i) for b, w, s, e, t in boxes for i, lon, lat in rows if w <= lon <= e and s <= lat <= t)
    assert got == want
    assert sorted((r.box, r.wpt_id) for r in spatial.boxes_with_points(frame, points).collect()) == want


@pytest.fixture(scope="module")
def crowd(spark):
    """Points of interest, boxes and features of which very many are copies of a few, one box over the date line, and nulls."""
    rng = random.Random(4)
    spots = [(14 + k * 0.003, 50 + k * 0.002) for k in range(8)] + [(179.9, 50.0), (-179.9, 50.0), (None, None)]
    pois = [(i, *rng.choice(spots)) for i in range(300)]
    boxes = [(k, *((14.0, 50.0, 14.01, 50.01) if k % 3 else (179.5, 49.5, -179.5, 50.5))) for k in range(40)]
    features = [(i, rng.choice(["node", "way"]), rng.random() < 0.5, i % 5, lon, lat, *((None,) * 4 if lon is None else (lon - 0.2, lat - 0.2, lon + 0.05, lat + 0.2))) for i, lon, lat in pois]
    sides = "west double, south double, east double, north double"
    return (
        spark.createDataFrame(pois, "wpt_id long, lon double, lat double"),
        spark.createDataFrame(boxes, f"area long, {sides}"),
        spark.createDataFrame(features, f"id long, kind string, closed boolean, chart_id long, lon double, lat double, {sides}"),
    )


def _joined(frame):
    """Pairs that a search compares at most, by the rows of its joins with places: copies aren't among them."""
    return sorted(tuple(r) for r in frame.collect())


def _holds(box, lon, lat):
    _, west, south, east, north = box
    return lon is not None and south <= lat <= north and (west <= lon <= east if west <= east else lon >= west or lon <= east)


def test_copies_are_counted_without_pairs(spark, crowd):
    """a box and a place that many share meet once."""
    _, boxes, features = crowd
    known, all_ = [tuple(r) for r in boxes.collect()], features.collect()
    out = spatial.features_counted(boxes, features, ["area"])
    inside = {b[0]: sum(_holds(b, f.lon, f.lat) for f in all_) for b in known}
    assert {r.area: r.inside for r in out.collect()} == inside and all(r.touching >= r.inside for r in out.collect())
    twice = spatial.features_counted(boxes, features.unionByName(features), ["area"])
    assert {r.area: (r.inside, r.touching) for r in twice.collect()} == {r.area: (2 * r.inside, 2 * r.touching) for r in out.collect()}
    met = spatial.boxes_with_boxes(spatial._shapes(boxes), features.groupBy("lon", "lat", "west", "south", "east", "north").count())
    assert met.count() <= 2 * 2 * 10


def test_any_of_many_places_makes_no_pairs(spark, crowd):
    """what lies near any place comes once, however many places find it."""
    pois, _, _ = crowd
    places = spark.range(5000).select((F.lit(14.0) + F.col("id") % 3 * 0.003).alias("lon"), (F.lit(50.0) + F.col("id") % 3 * 0.002).alias("lat"))
    got = _joined(spatial.near_any(places, pois, 100.0).select("wpt_id"))
    assert got == [(r.wpt_id,) for r in pois.orderBy("wpt_id").collect() if r.lon is not None and r.lon < 14.0061 and r.lon > 0]


def test_paths_find_places_once(spark, crowd):
    """points of interest at one place come with it; an id at two places comes once, null ids all."""
    pois, _, _ = crowd
    rows = [(t, 0, i, 14 + 0.02 * (i % 2), 50 + 0.01 * (i % 2), i * 2000.0) for t in range(4) for i in range(30)]
    path = spark.createDataFrame(rows, "track_id long, seg_no int, pt_no int, lon double, lat double, dist double")
    more = spark.createDataFrame([(7, 14.0, 50.0), (7, 14.003, 50.002), (None, 14.0, 50.0), (None, 14.003, 50.002)], "wpt_id long, lon double, lat double")
    out = spatial.near_paths(path, pois.where("wpt_id <> 7").unionByName(more), 1000.0)
    near = {r.wpt_id for r in pois.collect() if r.lon is not None and 0 < r.lon < 15} | {7, None}
    assert _joined(out.select("track_id", F.coalesce("wpt_id", F.lit(-1)))) == sorted((t, -1 if w is None else w) for t in range(4) for w in near)
    assert "Aggregate [wpt_id" not in spatial.near_paths(path, pois, 1000.0)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("most", [7, 1000])
def test_shared_keys_are_dealt_to_many_tasks(spark, crowd, most):
    """each row of a key goes with each hit once, in parts and whole."""
    pois, boxes, features = crowd
    hits = spark.createDataFrame([(k, 14 + k % 4 * 0.003, 50 + k % 4 * 0.002) for k in range(20)] + [(99, None, None)], "h long, lon double, lat double")
    got = _joined(spatial.expanded(hits, pois, ["lon", "lat"], most).select("h", "wpt_id"))
    assert got == sorted((h.h, p.wpt_id) for h in hits.collect() for p in pois.collect() if h.lon is not None and (h.lon, h.lat) == (p.lon, p.lat))
    known = [tuple(r) for r in boxes.collect()]
    want = sorted((b[0], f.id, "point" if f.kind == "node" else "area") for b in known for f in features.collect() if f.lon is not None and (f.kind == "node" or f.closed) and _holds(b, f.lon if f.kind == "node" else (f.west + f.east) / 2, (f.south + f.north) / 2 if f.kind == "way" else f.lat))
    found = spatial.features_in_boxes(boxes, features, ["area"])
    assert _joined(found.where("part <> 'path'")) == want and found.where("part = 'path'").distinct().count() == found.where("part = 'path'").count() > 0


def test_charts_meet_places_once(spark, crowd):
    """F8: features of charts that a box meets, by their places."""
    _, boxes, features = crowd
    charts = features.groupBy("chart_id").agg(*[f(c).alias(c) for c, f in (("west", F.min), ("south", F.min), ("east", F.max), ("north", F.max))]).where("chart_id <> 3")
    got = _joined(spatial.charts_then_features(boxes, charts, features.select("chart_id", "id", "lon", "lat"), ["area"]))
    assert got == sorted((b[0], f.chart_id, f.id) for b in [tuple(r) for r in boxes.collect()] for f in features.collect() if f.chart_id != 3 and _holds(b, f.lon, f.lat))


def test_tile_names_of_any_length(spark):
    """the given orders make tiles beyond the poles at size; a name holds all of their degrees and is read again."""
    from waymark.operators import tiles as sets
    from waymark.sources import terrain as reader

    places = [(14, 50), (-3, -1), (14, 123), (1000, -390)]
    named = spark.createDataFrame(places, "x int, y int").select(tiles.degree_tile_name(F.col("x"), F.col("y")).alias("file"), F.lit(1).alias("length"))
    assert sorted((r.tile_lon, r.tile_lat) for r in sets.terrain_catalog(named).collect()) == sorted(places)
    files = named.select(F.concat(F.lit("/dem/"), "file").alias("path"), F.unhex(F.lit("00010002" * 2)).alias("content"))
    assert sorted((r.tile_lon, r.tile_lat) for r in reader.samples_of(files).select("tile_lon", "tile_lat").distinct().collect()) == sorted(places)


def test_sql_of_great_circles_keeps_equal_points(spark):
    """a path may come back to a place after a long way; the check's arc of no length was no number there, the operator stays."""
    import duckdb

    from waymark.plans import places as queries

    sql = f"SELECT {queries.arc_sql('0.5e0')} FROM (SELECT *, {queries._ARC} AS arc FROM (SELECT 14.25e0 AS lon, 50.5e0 AS lat, 14.25e0 AS nlon, 50.5e0 AS nlat))"
    path = spark.createDataFrame([(1, 0, 0, 14.25, 50.5, 0.0), (1, 0, 1, 14.25, 50.5, 12000.0)], "track_id long, seg_no int, pt_no int, lon double, lat double, dist double")
    assert [(r.lon, r.lat) for r in spatial.densified(path, 5000.0).collect()] == [(14.25, 50.5)] * 4
    assert duckdb.sql(sql).fetchall() == [(14.25, 50.5)]


def test_matches_come_in_runs(spark):
    """a short block of rows meets all hits of its key before the next, so values repeat closely and files of them stay small."""
    hits = spark.range(60).select((F.col("id") * 31).alias("track_id"), (F.col("id") % 3 * 0.5).alias("lon"), F.lit(50.0).alias("lat"))
    pois = spark.range(2100).select("id", F.when(F.col("id") % 5 > 0, F.col("id")).alias("wpt_id"), F.lit("x").alias("name"), (F.col("id") % 3 * 0.5).alias("lon"), F.lit(50.0).alias("lat"))
    rows = spatial.expanded(hits, pois, ["lon", "lat"]).collect()
    assert sorted((r.track_id, r.id) for r in rows) == sorted((31 * h, p) for h in range(60) for p in range(2100) if h % 3 == p % 3)
    assert all((r.wpt_id, r.name, r.lon, r.lat) == (r.id if r.id % 5 else None, "x", r.id % 3 * 0.5, 50.0) for r in rows)
    runs = [[r.id for r in run] for _, run in groupby(rows, key=lambda r: r.track_id)]
    assert max(map(len, runs)) <= 256
    assert sum(a != b for a, b in zip(runs, runs[1:])) < 3 * 3


def test_grown_boxes_meet_places_once(spark, crowd):
    """areas of equal boxes and points at one place come with the one pair they share; none is lost or doubled."""
    pois, boxes, _ = crowd
    areas = boxes.unionByName(boxes.where("area < 3"))
    out = spatial.near_boxes(areas, pois, ["area"], 1000.0)
    assert out.columns == ["area", "wpt_id", "lon", "lat"]
    margin = math.degrees(1000.0 / geo.EARTH_RADIUS)
    grown = [(r.area, r.west - margin, r.south - margin, r.east + margin, r.north + margin) for r in areas.collect()]
    assert _joined(out.select("area", "wpt_id")) == sorted((b[0], p.wpt_id) for b in grown for p in pois.collect() if _holds(b, p.lon, p.lat))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [west#" in plan  # different boxes only


def test_features_of_boxes_come_in_runs(spark):
    """features at a place meet all areas of a box block by block."""
    boxes = spark.range(30).select(F.col("id").alias("area"), F.lit(14.0).alias("west"), F.lit(50.0).alias("south"), F.lit(14.1).alias("east"), F.lit(50.1).alias("north"))
    at = {"lon": F.lit(14.05), "lat": F.lit(50.05), "west": F.lit(14.0), "south": F.lit(50.0), "east": F.lit(14.1), "north": F.lit(50.1)}
    features = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, "node").otherwise("way").alias("kind"), (F.col("id") % 3 == 1).alias("closed"), *[c.alias(k) for k, c in at.items()])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as planned for large data
    try:
        rows = spatial.features_in_boxes(boxes, features, ["area"]).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    parts = ("point", "area", "path")
    assert sorted(map(tuple, rows)) == sorted((a, i, parts[i % 3]) for a in range(30) for i in range(900))
    assert max(len(list(run)) for _, run in groupby(rows, key=lambda r: (r.area, r.part == "path"))) <= 256
