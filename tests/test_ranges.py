"""Segments in ranges against segments in one window; exact medians against sorting."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import points, ranges, selection

SCHEMA = "track_id long, seg_no int, pt_no int, ts timestamp, lon double, lat double, ele double"
METRE = math.degrees(1 / 6378137.0)
SHOWN = "is_first own_times timed ds dt seg_dist seg_time raw_speed acceleration median mad is_stop pause is_outlier is_inner_stop dist raw_dist t v".split()


@pytest.fixture(scope="module")
def tracks(spark):
    """Stops of many lengths, jumps, repeated times, segments without times, gaps in the numbers and places that are missing."""
    rng, rows = random.Random(3), []
    for track in range(12):
        for seg in range(rng.randrange(1, 4)):
            t, north, at = 0.0, 0.0, 0
            for _ in range(rng.choice([1, 2, 9, 40, 90])):
                d, v = rng.choice([0.0, 1.0, 4.0, 9.0]), rng.choice([0.05, 0.05, 0.1, 0.1, 0.3, 3.0, 3.1, 60.0 if rng.random() < 0.1 else 0.1])
                t, north, at = t + d, north + d * v, at + rng.choice([1, 1, 1, 1, 7])
                ts = None if (track % 4 == 3 and seg == 1 and rng.random() < 0.2) else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t)
                rows.append((track, seg, at, ts, None if track == 5 and rng.random() < 0.1 else 14.0, north * METRE, 1.0))
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def rows(df, columns=SHOWN):
    def plain(v):
        return v if v is None or not isinstance(v, float) else float(f"{v:.9g}") + 0.0

    return {(r.track_id, r.seg_no, r.pt_no): tuple(plain(r[c]) for c in columns) for r in df.collect()}


@pytest.mark.parametrize("size", [3, 16])
def test_same_as_windows(tracks, size):
    want = points.enrich_points(tracks)
    got = ranges.enrich_ranges(tracks, size=size)
    assert sorted(got.columns) == sorted(want.columns)
    want, got = rows(want), rows(got)
    assert len(want) > 300 and any(r[SHOWN.index("is_inner_stop")] for r in want.values()) and any(r[SHOWN.index("is_outlier")] for r in want.values())
    assert got == want


@pytest.mark.parametrize("options", [points.TrackOptions(use_segments=False), points.TrackOptions(automatic_pause=False, pause_speed=1.0, pause_interval=3.0), points.TrackOptions(detect_pauses=False, eliminate_outliers=False)])
def test_options(tracks, options):
    columns = [c for c in SHOWN if options.eliminate_outliers or c not in ("median", "mad")]
    assert rows(ranges.enrich_ranges(tracks, options, size=5), columns) == rows(points.enrich_points(tracks, options), columns)


def test_extreme_tracks_only(spark, tracks):
    """Long tracks go in ranges, the others and one without an id by windows."""
    more = tracks.unionByName(tracks.where("track_id = 1").withColumn("track_id", F.lit(None).cast("long")))
    got = ranges.enrich_points(more, longest=60, size=8)
    sizes = [r["count"] for r in more.groupBy("track_id").count().collect()]
    assert min(sizes) <= 60 < max(sizes)
    assert rows(got) == rows(points.enrich_points(more))
    assert rows(ranges.enrich_points(more)) == rows(points.enrich_points(more))
    assert ranges.enrich_points(more.limit(0)).count() == 0


def test_one_track_is_many_tasks(spark):
    n = 20000
    one = spark.range(n).select(
        F.lit(1).alias("track_id"), F.lit(0).alias("seg_no"), F.col("id").cast("int").alias("pt_no"), F.timestamp_seconds(F.col("id")).alias("ts"),
        F.lit(14.0).alias("lon"), (F.col("id") * METRE).alias("lat"),
    )
    # as planned for large data: no merging of small partitions, and no small side that is broadcast
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = ranges.enrich_ranges(one, size=500)
        share = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(share) >= 4 and max(r.n for r in share) < n / 2
    last = out.where(f"pt_no = {n - 1}").first()
    assert abs(last.dist - (n - 1)) < 1e-3 and last.t == n - 1


def test_scans(spark):
    """Sums and last values over ranges that are empty, or hold nothing but nulls."""
    data = [(1, 0, k, float(k) if k in (3, 4, 40, 41, 90) else None) for k in [0, 3, 4, 11, 12, 13, 40, 41, 90, 95]]
    df = ranges.in_ranges(spark.createDataFrame(data, "track_id int, seg_no int, pt_no int, x double"), 10)
    got = {r.pt_no: (r.s, r.f) for r in ranges.SCAN.filled(ranges.SCAN.summed(df, s=F.col("x")), f=F.col("x")).collect()}
    assert got == {0: (None, None), 3: (3, 3), 4: (7, 4), 11: (7, 4), 12: (7, 4), 13: (7, 4), 40: (47, 40), 41: (88, 41), 90: (178, 90), 95: (178, 90)}


def test_exact_medians(spark):
    rng = random.Random(8)
    groups = {
        "one": [5.0],
        "ties": [2.0] * 50 + [3.0] * 49,
        "zeros": [0.0, -0.0, 0.0, -1.0, 1.0],
        "signs": [rng.choice([-1, 1]) * 10.0 ** rng.randrange(-300, 300) for _ in range(501)],
        "even": [1.0, 2.0, 3.0, 4.0],
        "ends": [-math.inf, math.inf, math.inf, 5e-324, -5e-324],
        "nan": [math.nan, math.nan, 1.0],
        "near": [1.0 + k * 2.0**-52 for k in range(1000)],
        "nulls": [None, None],
        "some": [None, 1.0, None, -7.5],
    }
    df = spark.createDataFrame([(k, x) for k, xs in groups.items() for x in rng.sample(xs, len(xs))], "k string, x double")
    got = {r.k: r.m for r in selection.upper_medians(df, ["k"], "x", "m").collect()}
    for k, xs in groups.items():
        known = sorted((x for x in xs if x is not None), key=lambda x: (math.isnan(x), x))
        if not known:
            assert k not in got
        else:
            want = known[len(known) // 2]
            assert got[k] == want or math.isnan(want) and math.isnan(got[k])
    plan = selection.upper_medians(df, ["k"], "x", "m")._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan
