"""Queries over scalar functions: units, texts, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import projection as P
from waymark.functions import texts, units
from waymark.plans.catalog import Register
from waymark.plans.fixtures import fixture, plain

register = Register()


_PO = f"WITH po AS ({plain('pois')})"
_EV = "WITH ev AS (SELECT event_id, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, ts FROM events)"


def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", "value", F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"), "ts")


@register("h02_radians", f"{_PO} SELECT wpt_id, round(radians(lon), 9) AS rad, round(degrees(radians(lat)), 6) AS deg FROM po")
def _(spark, d):
    return fixture(spark, d, "pois").select("wpt_id", F.round(F.radians("lon"), 9).alias("rad"), F.round(F.degrees(F.radians("lat")), 6).alias("deg"))


@register("h16_units", f"{_EV} SELECT event_id, round(value * 0.001e0, 6) AS km, round(value * 0.00062137119223733e0, 6) AS mi, round(value * 0.00053995680345572e0, 6) AS nmi, round(value * 3.2808398950131e0, 6) AS ft, round(value * 3.6e0, 6) AS kmh, round(value * 1.9438444924406e0, 6) AS kn, round(k * 1.8e0 + 32, 6) AS fahrenheit FROM ev")
def _(spark, d):
    v = F.col("value")
    return _events(spark, d).select(
        "event_id", *[F.round(units.converted(v, u), 6).alias(n) for u, n in (("km", "km"), ("mi", "mi"), ("nmi", "nmi"), ("ft", "ft"), ("km/h", "kmh"), ("kn", "kn"))], F.round(units.fahrenheit(F.col("k")), 6).alias("fahrenheit")
    )


@register("h17_distance_texts", f"{_EV}, m AS (SELECT event_id, (k * k * 3 + 7) * 1.013e0 AS m FROM ev) SELECT event_id, CASE WHEN m / 1000 < 1 THEN printf('%.0f', m) || ' m' WHEN m / 1000 < 10 THEN printf('%.2f', m / 1000) || ' km' ELSE printf('%.1f', m / 1000) || ' km' END AS metric FROM m")
def _(spark, d):
    m = (F.col("k") * F.col("k") * 3 + 7) * 1.013
    return _events(spark, d).select("event_id", units.distance_text(m).alias("metric"))


@register("h18_span_texts", f"{_EV}, s AS (SELECT event_id, CAST(floor(k * 97.3e0) AS BIGINT) AS s FROM ev) SELECT event_id, CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%02d:%02d', s // 60 % 60, s % 60) END AS span FROM s")
def _(spark, d):
    return _events(spark, d).select("event_id", units.time_span_text(F.col("k") * 97.3).alias("span"))


_DMS = """CAST(floor(abs(V)) AS BIGINT) AS Vd, (abs(V) - floor(abs(V))) * 60e0 AS Vm"""


@register("h19_coordinate_texts", f"""{_PO}, p AS (SELECT wpt_id, lat - 50.2 AS a, lon - 14.4 AS o FROM po), q AS (SELECT *, {_DMS.replace('V', 'a')}, {_DMS.replace('V', 'o')}, CASE WHEN a < 0 THEN 'S' ELSE 'N' END AS ns, CASE WHEN o < 0 THEN 'W' ELSE 'E' END AS ew FROM p)
SELECT wpt_id, printf('%.5f, %.5f', a, o) AS decimal, printf('%d° %06.3f''', ad, am) || ns || ', ' || printf('%d° %06.3f''', od, om) || ew AS ddm,
printf('%d° %02d'' %04.1f"', ad, CAST(floor(am) AS BIGINT), (am - floor(am)) * 60) || ns || ', ' || printf('%d° %02d'' %04.1f"', od, CAST(floor(om) AS BIGINT), (om - floor(om)) * 60) || ew AS dms FROM q""")
def _(spark, d):
    # places a little off round decimals, so that no last digit hangs on how two engines round halves
    rows = fixture(spark, d, "pois").select("wpt_id", (F.col("lat") - 50.2).alias("lat"), (F.col("lon") - 14.4).alias("lon"))
    lon, lat = F.col("lon"), F.col("lat")
    return rows.select("wpt_id", units.decimal_text(lon, lat).alias("decimal"), units.degrees_minutes_text(lon, lat).alias("ddm"), units.degrees_minutes_seconds_text(lon, lat).alias("dms"))


@register("h20_parsed_angles", f"""{_PO} SELECT wpt_id, round(47 + (wpt_id % 6000) / 100 / 60e0, 6) AS nmea, round(-(8 + (wpt_id % 60000) / 1000e0 / 60), 6) AS igc,
CASE WHEN wpt_id % 70000 < 60000 THEN round((14 + (wpt_id % 70000) / 1000e0 / 60) * CASE WHEN wpt_id % 2 = 0 THEN -1 ELSE 1 END, 6) END AS cup, round((wpt_id % 90000) / 1000e0 * CASE WHEN wpt_id % 3 = 0 THEN -1 ELSE 1 END, 6) AS marked FROM po""")
def _(spark, d):
    i = F.col("wpt_id")
    nmea = F.concat(F.lit("47"), F.lpad(F.format_string("%.2f", (i % 6000) / 100.0), 5, "0"))
    igc = F.concat(F.lit("008"), F.lpad((i % 60000).cast("string"), 5, "0"), F.lit("W"))
    m = i % 70000  # minutes from 60 on are malformed
    cup = F.concat(F.lit("014"), F.lpad(F.floor(m / 1000).cast("string"), 2, "0"), F.lit("."), F.lpad((m % 1000).cast("string"), 3, "0"), F.when(i % 2 == 0, "W").otherwise("E"))
    marked = F.concat(F.format_string("%.3f", (i % 90000) / 1000.0), F.lit("\u00ba"), F.when(i % 3 == 0, "S").otherwise("N"))
    return fixture(spark, d, "pois").select(
        "wpt_id", F.round(texts.nmea_angle(nmea, F.lit("N")), 6).alias("nmea"), F.round(texts.igc_angle(igc), 6).alias("igc"), F.round(texts.cup_angle(cup), 6).alias("cup"), F.round(texts.marked_angle(marked, "N", "S"), 6).alias("marked")
    )


@register("h21_time_zones", "SELECT user_id, min(ts) + INTERVAL 5 HOUR + INTERVAL 30 MINUTE AS first_local, max(ts) + INTERVAL 5 HOUR + INTERVAL 30 MINUTE AS last_local FROM events GROUP BY 1")
def _(spark, d):
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Kolkata")
    return spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.min(local).cast("timestamp_ntz").alias("first_local"), F.max(local).cast("timestamp_ntz").alias("last_local"))


@register("h22_day_numbers", "SELECT o_orderkey, make_timestamp(CAST(round((30000 + o_orderkey % 10000 + 0.25e0 - 25569e0) * 86400000) AS BIGINT) * 1000) AS t FROM orders")
def _(spark, d):
    days = 30000 + F.col("o_orderkey") % 10000 + 0.25
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", texts.day_number_time(days).cast("timestamp_ntz").alias("t"))


@register("h24_templates", "SELECT p_partkey, p_brand || ' (' || CASE WHEN p_size > 10 THEN p_type ELSE '' END || ')' AS label FROM part")
def _(spark, d):
    tags = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.when(F.col("p_size") > 10, F.col("p_type")))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", texts.template("{brand} ({type})", tags, ["brand", "type"]).alias("label"))


@register("h25_addresses", "SELECT c_custkey, concat_ws(chr(10), CASE WHEN c_custkey % 3 <> 0 THEN c_name END, CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_nationkey AS VARCHAR) || ' ' ELSE '' END || c_mktsegment, CASE WHEN c_custkey % 5 <> 0 THEN 'Land' END) AS address FROM customer")
def _(spark, d):
    some = lambda n, v: F.when(F.col("c_custkey") % n != 0, v).otherwise(F.lit(""))
    text = texts.address(some(3, F.col("c_name")), some(4, F.col("c_nationkey").cast("string")), F.col("c_mktsegment"), F.lit(""), some(5, F.lit("Land")))
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", text.alias("address"))


_NICE = "CASE WHEN V / pow(10, floor(log10(V))) LESS A THEN 1 WHEN V / pow(10, floor(log10(V))) LESS B THEN 2 WHEN V / pow(10, floor(log10(V))) LESS C THEN 5 ELSE 10 END * pow(10, floor(log10(V)))"
_UP, _NEAR = _NICE.replace("LESS A", "<= 1").replace("LESS B", "<= 2").replace("LESS C", "<= 5"), _NICE.replace("LESS A", "< 1.5e0").replace("LESS B", "< 3").replace("LESS C", "< 7")


@register("h26_nice_numbers", f"""{_EV}, n AS (SELECT event_id, k + 1e0 AS x, k - 30e0 AS low, k * 1.7e0 + 12 AS high FROM ev), u AS (SELECT *, {_UP.replace('V', 'x')} AS up, {_NEAR.replace('V', 'x')} AS near, {_UP.replace('V', '(high - low)')} / 6e0 AS raw FROM n),
t AS (SELECT *, {_NEAR.replace('V', 'raw')} AS step FROM u) SELECT event_id, up, near, ceil(low / step) * step AS tick, step, CAST(round((floor(high / step) * step - ceil(low / step) * step) / step) AS INT) + 1 AS ticks FROM t""")
def _(spark, d):
    x, k = F.col("k") + 1.0, F.col("k")
    t = units.ticks(k - 30.0, k * 1.7 + 12.0, 6)
    return _events(spark, d).select("event_id", units.nice_number(x).alias("up"), units.nice_number(x, True).alias("near"), t.alias("t")).select("event_id", "up", "near", F.col("t.first").alias("tick"), "t.step", F.col("t.n").alias("ticks"))


@register("h30_motion_texts", f"{_EV} SELECT event_id, printf('%.1f', value * 3.6e0) || ' km/h' AS speed, printf('%.1f', k * 196.85039370079e0) || ' ft/min' AS climb FROM ev")
def _(spark, d):
    return _events(spark, d).select("event_id", units.speed_text(F.col("value")).alias("speed"), units.vertical_speed_text(F.col("k"), "imperial").alias("climb"))


#: Published parameters of a few datums (Bessel and International ellipsoids to WGS 84).
DATUMS = (
    ("S-JTSK", 6377397.155, 299.1528128, 589.0, 76.0, 480.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    ("ED50", 6378388.0, 297.0, -87.0, -98.0, -121.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    ("DHDN", 6377397.155, 299.1528128, 598.1, 73.7, 418.2, 0.202, 0.045, -2.455, 6.7, 0.0),
)


def datums(spark):
    return spark.createDataFrame(DATUMS, "datum string, radius double, inverse_flattening double, dx double, dy double, dz double, rx double, ry double, rz double, ds double, meridian_shift double")


def _xyz(lon: str, lat: str, a: str, f: str) -> str:
    e2 = f"((1 / {f}) * (2 - 1 / {f}))"
    n = f"({a} / sqrt(1 - {e2} * sin(radians({lat})) * sin(radians({lat}))))"
    return f"{n} * cos(radians({lat})) * cos(radians({lon})) AS x, {n} * cos(radians({lat})) * sin(radians({lon})) AS y, {n} * (1 - {e2}) * sin(radians({lat})) AS z"


@register(
    "h09_j08_datum_shift",
    f"""{_PO}, g AS (SELECT wpt_id, {_xyz('lon', 'lat', '6377397.155e0', '299.1528128e0')} FROM po),
h AS (SELECT wpt_id, 1.0000067e0 * (x - radians(-2.455e0 / 3600) * y + radians(0.045e0 / 3600) * z) + 598.1e0 AS x, 1.0000067e0 * (radians(-2.455e0 / 3600) * x + y - radians(0.202e0 / 3600) * z) + 73.7e0 AS y, 1.0000067e0 * (-radians(0.045e0 / 3600) * x + radians(0.202e0 / 3600) * y + z) + 418.2e0 AS z FROM g),
p AS (SELECT *, sqrt(x * x + y * y) AS p, (1 / 298.257223563e0) * (2 - 1 / 298.257223563e0) AS e2 FROM h), t AS (SELECT *, 6378137e0 * sqrt(1 - e2) AS b, atan2(z * 6378137e0, p * 6378137e0 * sqrt(1 - e2)) AS th FROM p)
SELECT wpt_id, round(degrees(atan2(y, x)), 7) AS lon, round(degrees(atan2(z + e2 / (1 - e2) * b * pow(sin(th), 3), p - e2 * 6378137e0 * pow(cos(th), 3))), 7) AS lat FROM t""",
)
def _(spark, d):
    rows = fixture(spark, d, "pois").select("wpt_id", "lon", "lat", F.lit("DHDN").alias("datum"))
    good, _unknown = P.to_wgs84(rows, datums(spark))
    return good.select("wpt_id", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))


@register("j08_unknown_datums", f"{_PO} SELECT wpt_id FROM po WHERE file NOT IN ('BUILDING', 'MACHINERY')")
def _(spark, d):
    known = datums(spark).limit(2).withColumn("datum", F.when(F.col("datum") == "ED50", "BUILDING").otherwise("MACHINERY"))
    rows = fixture(spark, d, "pois").select("wpt_id", "lon", "lat", F.col("file").alias("datum"))
    return P.to_wgs84(rows, known)[1].select("wpt_id")


@register("h10_web_mercator", f"{_PO} SELECT wpt_id, round(radians(lon) * 6378137, 3) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137, 3) AS y FROM po")
def _(spark, d):
    x, y = P.web_mercator(F.col("lon"), F.col("lat"))
    return fixture(spark, d, "pois").select("wpt_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def _krueger() -> str:
    """Forward transverse Mercator in SQL, hyperbolic functions written out."""
    _, alpha, _ = P._series()
    n = 1.0 / (2.0 * P.WGS84_INVERSE_FLATTENING - 1.0)
    side = f"{6378137.0 / (1 + n) * (1 + n * n / 4 + n**4 / 64) * 0.9996!r}"
    e = f"{(2 / P.WGS84_INVERSE_FLATTENING - 1 / P.WGS84_INVERSE_FLATTENING**2) ** 0.5!r}"
    east = " + ".join(f"{a!r} * cos({2 * k} * xi) * (exp({2 * k} * eta) - exp(-{2 * k} * eta)) / 2" for k, a in enumerate(alpha, 1))
    north = " + ".join(f"{a!r} * sin({2 * k} * xi) * (exp({2 * k} * eta) + exp(-{2 * k} * eta)) / 2" for k, a in enumerate(alpha, 1))
    return f"""s2 AS (SELECT *, CAST(floor((lon + 180) / 6) AS INT) + 1 AS z0, sin(radians(lat)) AS q FROM s), s3 AS (SELECT *, ln((1 + q) / (1 - q)) / 2 - {e} * ln((1 + {e} * q) / (1 - {e} * q)) / 2 AS psi, radians(lon - (z0 * 6 - 183)) AS lam FROM s2),
s4 AS (SELECT *, (exp(psi) - exp(-psi)) / 2 AS tc FROM s3), s5 AS (SELECT *, atan2(tc, cos(lam)) AS xi, sin(lam) / sqrt(1 + tc * tc) AS w FROM s4), s6 AS (SELECT *, ln((1 + w) / (1 - w)) / 2 AS eta FROM s5)
SELECT wpt_id, CASE WHEN lat < 0 THEN -z0 ELSE z0 END AS zone, round(500000 + {side} * (eta + {east}), 3) AS x, round(CASE WHEN lat < 0 THEN 10000000 ELSE 0 END + {side} * (xi + {north}), 3) AS y, round(lon, 6) AS lon, round(lat, 6) AS lat FROM s6"""


@register("h10_utm", f"{_PO}, s AS (SELECT wpt_id, lon + (wpt_id % 11) * 3 - 15 AS lon, CASE WHEN wpt_id % 2 = 0 THEN -lat ELSE lat - 10 END AS lat FROM po), {_krueger()}")
def _(spark, d):
    rows = fixture(spark, d, "pois").select("wpt_id", (F.col("lon") + (F.col("wpt_id") % 11) * 3 - 15).alias("lon"), F.when(F.col("wpt_id") % 2 == 0, -F.col("lat")).otherwise(F.col("lat") - 10).alias("lat"))
    zone, x, y = P.utm(F.col("lon"), F.col("lat"))
    there = rows.select("wpt_id", zone.alias("zone"), x.alias("x"), y.alias("y"))
    lon, lat = P.from_utm(F.col("zone"), F.col("x"), F.col("y"))
    return there.select("wpt_id", "zone", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@register("h11_utm_zones", f"{_PO}, s AS (SELECT wpt_id, (wpt_id * 7 % 360) - 180e0 AS lon, (wpt_id * 13 % 160) - 76e0 AS lat FROM po), z AS (SELECT *, CASE WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32 WHEN lat >= 72 AND lat < 84 AND lon >= 0 AND lon < 9 THEN 31 WHEN lat >= 72 AND lat < 84 AND lon >= 9 AND lon < 21 THEN 33 WHEN lat >= 72 AND lat < 84 AND lon >= 21 AND lon < 33 THEN 35 WHEN lat >= 72 AND lat < 84 AND lon >= 33 AND lon < 42 THEN 37 ELSE CAST(floor((lon + 180) / 6) AS INT) + 1 END AS zone FROM s) SELECT wpt_id, CASE WHEN lat < 0 THEN -zone ELSE zone END AS zone FROM z")
def _(spark, d):
    rows = fixture(spark, d, "pois").select("wpt_id", ((F.col("wpt_id") * 7 % 360) - 180.0).alias("lon"), ((F.col("wpt_id") * 13 % 160) - 76.0).alias("lat"))
    return rows.select("wpt_id", P.utm_zone(F.col("lon"), F.col("lat")).alias("zone"))


@register("h31_boxes_reprojected", f"""WITH ar AS (SELECT *, CASE WHEN west > east THEN east + 360 - west ELSE east - west END AS width FROM ({plain('areas')})), sm AS (SELECT *, west + k / 100e0 * width AS far FROM ar, range(101) r(k))
SELECT area_id, round(radians(min(far - 360 * round_even(far / 360, 0))) * 6378137, 3) AS x_min, round(ln(tan(pi() / 4 + radians(min(south)) / 2)) * 6378137, 3) AS y_min,
round(radians(max(far - 360 * round_even(far / 360, 0))) * 6378137, 3) AS x_max, round(ln(tan(pi() / 4 + radians(max(north)) / 2)) * 6378137, 3) AS y_max FROM sm GROUP BY 1""")
def _(spark, d):
    out = P.box_reprojected(fixture(spark, d, "areas"), ["area_id"])
    return out.select("area_id", *[F.round(c, 3).alias(c) for c in ("x_min", "y_min", "x_max", "y_max")])
