"""Hand-computed cases of motion, pauses, outliers and chaining."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import channels, points, stats, thinning

SCHEMA = "track_id long, seg_no int, pt_no int, ts timestamp, lon double, lat double, ele double, speed double, heart_rate double, temperature double, cadence double, power double, ratio double"
METRE = math.degrees(1 / 6378137.0)  # of latitude
START = dt.datetime(2024, 1, 1)


def track(spark, *segments, track_id=1):
    """Segments of (seconds or None, metres north[, elevation])."""
    rows = []
    for s, seg in enumerate(segments):
        for i, (t, north, *more) in enumerate(seg):
            rows.append((track_id, s, i, None if t is None else START + dt.timedelta(seconds=t), 14.0, north * METRE, more[0] if more else None, *[None] * 6))
    return spark.createDataFrame(rows, SCHEMA)


def values(df, *columns):
    return [tuple(r) for r in df.orderBy("track_id", "seg_no", "pt_no").select(*columns).collect()]


def test_distance_time_and_speed_go_on_between_segments(spark):
    e = points.enrich_points(track(spark, [(0, 0), (10, 100), (10, 150), (20, 250)], [(100, 5000), (110, 5100)]), points.TrackOptions(eliminate_outliers=False, detect_pauses=False))
    got = values(e, "dist", "t", "v")
    assert [round(d, 3) for d, _, _ in got] == [0, 100, 150, 250, 250, 350]
    assert [t for _, t, _ in got] == [0, 10, 10, 20, 20, 30]
    assert [round(v, 6) for _, _, v in got] == [0, 10, 10, 10, 0, 10]


def test_missing_time_silences_its_segment_and_all_later(spark):
    e = points.enrich_points(track(spark, [(0, 0), (10, 100)], [(20, 100), (None, 200), (40, 300)], [(50, 300), (60, 400)]))
    got = values(e, "timed", "t", "v", "is_outlier")
    assert [x[0] for x in got] == [True, True] + [False] * 5 and [x[1] for x in got][2:] == [None] * 5
    assert round(values(e, "dist")[-1][0], 3) == 400


def test_pause_is_extended_to_the_point_before(spark):
    still = [(0, 0), (10, 100), (20, 100.5), (30, 101), (35, 101.2), (45, 200)]
    e = points.enrich_points(track(spark, still), points.TrackOptions(eliminate_outliers=False))
    assert [s for (s,) in values(e, "is_stop")] == [False, True, True, True, True, False]
    assert [p for (p,) in values(e, "pause")] == [0, 0, 0, 0, 25, 0]
    short = points.enrich_points(track(spark, [(0, 0), (10, 100), (20, 100), (30, 200)]), points.TrackOptions(eliminate_outliers=False))
    assert not any(s for (s,) in values(short, "is_stop"))  # not longer than the interval


def pauses_by_loop(speed, t, limit, interval):
    """The rule as a walk along the points: a growing stop that is counted as soon as it is long enough."""
    stops, total, begin, counted = set(), 0.0, 0, 0
    for j in range(1, len(t)):
        if speed[j] > limit:
            begin = -1
        elif begin < 0:
            begin = j - 1
        if begin >= 0 and t[j] > t[begin] + interval:
            first = max(begin, counted)
            total += t[j] - t[first]
            stops.update(range(first, j + 1))
            counted = j
    return stops, total


def test_pauses_match_the_walk(spark):
    rng = random.Random(7)
    frames, want = None, {}
    for k in range(60):
        t, north, rows, speed = 0.0, 0.0, [], [0.0]
        for i in range(rng.randrange(2, 25)):
            if i:
                d, v = rng.choice([0.0, 1.0, 4.0, 9.0, 15.0]), rng.choice([0.1, 0.3, 0.45, 3.0])
                t += d
                north += d * v
                speed.append(v if d else speed[-1])
            rows.append((t, north))
        want[k] = pauses_by_loop(speed, [r[0] for r in rows], 0.4, 10.0)
        part = track(spark, rows, track_id=k)
        frames = part if frames is None else frames.unionByName(part)
    options = points.TrackOptions(automatic_pause=False, pause_speed=0.4, eliminate_outliers=False)
    got = points.enrich_points(frames, options).groupBy("track_id").agg({"pause": "sum"}).collect()
    assert {r[0]: round(r[1], 6) for r in got} == {k: round(total, 6) for k, (_, total) in want.items()}
    stops = points.enrich_points(frames, options).where("is_stop").select("track_id", "pt_no").collect()
    assert {(r[0], r[1]) for r in stops} == {(k, j) for k, (s, _) in want.items() for j in s}


def test_outliers_and_clean_distance(spark):
    rows = [(i * 10, i * 50 + (i % 3)) for i in range(12)]
    rows[6] = (60, 9000)
    e = points.enrich_points(track(spark, rows, [(200, 600), (210, 650)]))
    flags = [o for (o,) in values(e, "is_outlier")]
    assert flags[6] and not flags[0]
    kept = [d for d, o in values(e, "dist", "is_outlier") if not o]
    assert kept == sorted(kept) and kept[-1] < 1000


def test_upper_median_and_zero_deviation(spark):
    df = spark.createDataFrame([(1, 0, float(v)) for v in (1, 2, 3, 4)] + [(2, 0, 5.0), (2, 0, 5.0), (2, 0, 9.0)], "track_id long, seg_no int, x double")
    got = {r.track_id: r.m for r in points.upper_median(df, "x", "m").collect()}
    assert got == {1: 3.0, 2: 5.0}


def test_smoothing_holds_the_edges(spark):
    seg = [(i, i * 10.0, float(e)) for i, e in enumerate([0, 3, 6, 0, 9])]
    e = points.enrich_points(track(spark, seg, [(100, 50.0, 7.0), (101, 60.0, 8.0)]), points.TrackOptions(eliminate_outliers=False, detect_pauses=False))
    g = channels.graph(e, ["elevation"]).orderBy("seg_no", "g_no").collect()
    assert [r.y for r in g] == [3, 3, 3, 5, 5, 7, 8]
    climb = stats.climb(channels.graph(e, ["elevation"])).first()
    assert (climb.ascent, climb.descent) == (3, 0)
    with pytest.raises(ValueError):
        channels.smoothed(channels.unpivoted(e, ["elevation"]), {"elevation": 4})


def test_tied_ratio_takes_the_smallest(spark):
    df = spark.createDataFrame([(1, 2.0, 10.0), (1, 1.5, 10.0), (1, 3.0, 4.0)], "track_id long, y double, ridden double")
    assert stats.most_used(df, ["track_id"]).first().top == 1.5


def test_thinning_keeps_ends(spark):
    df = spark.createDataFrame([(1, "x", 0, i, i * 0.3, None, 0.0) for i in range(10)], "track_id long, channel string, seg_no int, g_no int, s double, t double, y double")
    assert sorted(r.g_no for r in thinning.thinned(df, 1.0, 1.0).collect()) == [0, 4, 8, 9]


def test_empty_input(spark):
    empty = spark.createDataFrame([], SCHEMA)
    e = points.enrich_points(empty)
    assert e.count() == 0 and channels.graph(e).count() == 0 and stats.track_totals(e).count() == 0


def test_thinning_goes_on_from_batch_to_batch(spark):
    rng = random.Random(9)
    rows = [(t, c, s, g, g * 40.0, rng.uniform(0, 4)) for t in range(5) for c in ("a", "b") for s in range(2) for g in range(rng.choice([1, 2, 3, 40]))]
    graph = spark.createDataFrame(rng.sample(rows, len(rows)), "track_id long, channel string, seg_no int, g_no int, s double, y double")
    want = set()
    for key in {r[:3] for r in rows}:
        series = sorted(r for r in rows if r[:3] == key)
        kept = series[0]
        for r in series:
            if r in (series[0], series[-1]) or abs(r[4] * 0.01 - kept[4] * 0.01) >= 1 or abs(r[5] * 0.5 - kept[5] * 0.5) >= 1:
                want.add(r)
                kept = r
    for batch in ("1", "3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = [tuple(r) for r in thinning.thinned(graph, 0.01, 0.5).collect()]
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(got) == len(set(got)) and set(got) == want
    assert thinning.thinned(graph.limit(0), 1.0, 1.0).count() == 0


def test_tracks_are_dealt_by_points(spark):
    """tasks of the windows over tracks are as many as the points need, however few bytes are shuffled; tracks stay whole."""
    rows = spark.range(20_000).selectExpr("id % 100 track_id", "0 seg_no", "cast(id as int) pt_no", "timestamp_seconds(id) ts", "14d lon", "50d lat")
    assert points.by_track(rows, 1000).rdd.getNumPartitions() == 20
    assert points.enrich_points(rows.where("track_id < 3")).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1
    spread = points.by_track(rows, 1000).withColumn("task", F.spark_partition_id())
    assert spread.groupBy("track_id").agg(F.countDistinct("task").alias("n")).where("n > 1").count() == 0
    assert points.by_track(rows.limit(0)).count() == 0
