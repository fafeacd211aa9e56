"""Datum shifts and map projections as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import geo

#: WGS 84: semi-major axis and inverse flattening.
WGS84_RADIUS, WGS84_INVERSE_FLATTENING = 6378137.0, 298.257223563
_DATUM = ("radius", "inverse_flattening", "dx", "dy", "dz", "rx", "ry", "rz", "ds", "meridian_shift")


def _e2(inverse_flattening: Column | float) -> Column:
    f = 1.0 / (inverse_flattening if isinstance(inverse_flattening, Column) else F.lit(inverse_flattening))
    return f * (2.0 - f)


def to_geocentric(lon: Column, lat: Column, radius: Column, inverse_flattening: Column) -> tuple[Column, Column, Column]:
    e2 = _e2(inverse_flattening)
    phi, lam = F.radians(lat), F.radians(lon)
    n = radius / F.sqrt(1.0 - e2 * F.sin(phi) * F.sin(phi))
    return n * F.cos(phi) * F.cos(lam), n * F.cos(phi) * F.sin(lam), n * (1.0 - e2) * F.sin(phi)


def from_geocentric(x: Column, y: Column, z: Column, radius: Column, inverse_flattening: Column) -> tuple[Column, Column]:
    """(lon, lat) of a place near the surface, by Bowring's formula."""
    e2 = _e2(inverse_flattening)
    b = radius * F.sqrt(1.0 - e2)
    p = F.sqrt(x * x + y * y)
    theta = F.atan2(z * radius, p * b)
    lat = F.atan2(z + e2 / (1.0 - e2) * b * F.pow(F.sin(theta), 3), p - e2 * radius * F.pow(F.cos(theta), 3))
    return F.degrees(F.atan2(y, x)), F.degrees(lat)


def helmert(x: Column, y: Column, z: Column, p: dict[str, Column]) -> tuple[Column, Column, Column]:
    """Seven parameters: shifts in metres, rotations in seconds of arc (position vector), scale in parts a million."""
    rx, ry, rz = (F.radians(p[k] / 3600.0) for k in ("rx", "ry", "rz"))
    m = 1.0 + p["ds"] * 1e-6
    return m * (x - rz * y + ry * z) + p["dx"], m * (rz * x + y - rx * z) + p["dy"], m * (-ry * x + rx * y + z) + p["dz"]


def helmert_back(x: Column, y: Column, z: Column, p: dict[str, Column]) -> tuple[Column, Column, Column]:
    rx, ry, rz = (F.radians(p[k] / 3600.0) for k in ("rx", "ry", "rz"))
    m = 1.0 + p["ds"] * 1e-6
    x, y, z = (x - p["dx"]) / m, (y - p["dy"]) / m, (z - p["dz"]) / m
    return x + rz * y - ry * z, -rz * x + y + rx * z, ry * x - rx * y + z


def molodensky(lon: Column, lat: Column, p: dict[str, Column]) -> tuple[Column, Column]:
    """Three parameters without a geocentric detour: changes of latitude and longitude to WGS 84."""
    a, f = p["radius"], 1.0 / p["inverse_flattening"]
    da, df = WGS84_RADIUS - a, 1.0 / WGS84_INVERSE_FLATTENING - f
    e2 = f * (2.0 - f)
    phi, lam = F.radians(lat), F.radians(lon)
    sin_p, cos_p = F.sin(phi), F.cos(phi)
    rn = a / F.sqrt(1.0 - e2 * sin_p * sin_p)
    rm = a * (1.0 - e2) / F.pow(1.0 - e2 * sin_p * sin_p, 1.5)
    b_over_a = 1.0 - f
    north = -p["dx"] * sin_p * F.cos(lam) - p["dy"] * sin_p * F.sin(lam) + p["dz"] * cos_p
    north = north + da * (rn * e2 * sin_p * cos_p) / a + df * (rm / b_over_a + rn * b_over_a) * sin_p * cos_p
    east = -p["dx"] * F.sin(lam) + p["dy"] * F.cos(lam)
    return lon + F.degrees(east / (rn * cos_p)), lat + F.degrees(north / rm)


def to_wgs84(df: DataFrame, datums: DataFrame, datum: str = "datum", lon: str = "lon", lat: str = "lat") -> tuple[DataFrame, DataFrame]:
    """(shifted rows, rows of unknown datum).

    ``datums`` (datum and its parameters) has a row for each known datum; the
    list is a small, fixed table, so it is broadcast.
    """
    table = F.broadcast(datums.select(datum, *_DATUM))
    joined = df.join(table, datum)
    p = {k: F.coalesce(F.col(k).cast("double"), F.lit(0.0)) for k in _DATUM}
    greenwich = F.col(lon) + p["meridian_shift"]
    seven = (p["rx"] != 0) | (p["ry"] != 0) | (p["rz"] != 0) | (p["ds"] != 0)
    xyz = helmert(*to_geocentric(greenwich, F.col(lat), p["radius"], p["inverse_flattening"]), p)
    h_lon, h_lat = from_geocentric(*xyz, F.lit(WGS84_RADIUS), F.lit(WGS84_INVERSE_FLATTENING))
    m_lon, m_lat = molodensky(greenwich, F.col(lat), p)
    out = joined.withColumns({"\u0001lon": F.when(seven, h_lon).otherwise(m_lon), "\u0001lat": F.when(seven, h_lat).otherwise(m_lat)})
    out = out.withColumns({lon: F.col("\u0001lon"), lat: F.col("\u0001lat")}).select(*df.columns)
    return out, df.join(datums.select(datum), datum, "left_anti")


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Metres east and north on the sphere."""
    return F.radians(lon) * WGS84_RADIUS, F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2.0)) * WGS84_RADIUS


def from_web_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / WGS84_RADIUS), F.degrees(2.0 * F.atan(F.exp(y / WGS84_RADIUS)) - 1.5707963267948966)


def _series() -> tuple[float, list[float], list[float]]:
    """Rectifying radius and the series coefficients of the transverse Mercator projection (third flattening to the fourth power)."""
    n = 1.0 / (2.0 * WGS84_INVERSE_FLATTENING - 1.0)
    n2, n3, n4 = n * n, n**3, n**4
    radius = WGS84_RADIUS / (1.0 + n) * (1.0 + n2 / 4.0 + n4 / 64.0)
    forward = [n / 2 - 2 * n2 / 3 + 5 * n3 / 16 + 41 * n4 / 180, 13 * n2 / 48 - 3 * n3 / 5 + 557 * n4 / 1440, 61 * n3 / 240 - 103 * n4 / 140, 49561 * n4 / 161280]
    back = [n / 2 - 2 * n2 / 3 + 37 * n3 / 96 - n4 / 360, n2 / 48 + n3 / 15 - 437 * n4 / 1440, 17 * n3 / 480 - 37 * n4 / 840, 4397 * n4 / 161280]
    return radius, forward, back


def transverse_mercator(lon: Column, lat: Column, central: Column, scale: float = 0.9996, east: float = 500000.0, north: Column | float = 0.0) -> tuple[Column, Column]:
    """Metres east and north (WGS 84), by Krueger's series."""
    radius, alpha, _ = _series()
    e = (1.0 / WGS84_INVERSE_FLATTENING * (2.0 - 1.0 / WGS84_INVERSE_FLATTENING)) ** 0.5
    phi, lam = F.radians(lat), F.radians(lon - central)
    conformal = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(conformal, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1.0 + conformal * conformal))
    x, y = eta, xi
    for k, a in enumerate(alpha, 1):
        x = x + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        y = y + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return x * (radius * scale) + east, y * (radius * scale) + north


def from_transverse_mercator(x: Column, y: Column, central: Column, scale: float = 0.9996, east: float = 500000.0, north: Column | float = 0.0) -> tuple[Column, Column]:
    radius, _, beta = _series()
    xi, eta = (y - north) / (radius * scale), (x - east) / (radius * scale)
    xi0, eta0 = xi, eta
    for k, b in enumerate(beta, 1):
        xi0 = xi0 - b * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        eta0 = eta0 - b * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    conformal = F.sin(xi0) / F.sqrt(F.pow(F.sinh(eta0), 2) + F.pow(F.cos(xi0), 2))
    lam = F.atan2(F.sinh(eta0), F.cos(xi0))
    # latitude from conformal latitude by its own series, so that no term grows with each step
    chi = F.atan(conformal)
    n = 1.0 / (2.0 * WGS84_INVERSE_FLATTENING - 1.0)
    series = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
    lat = chi
    for k, delta in enumerate(series, 1):
        lat = lat + delta * F.sin(2 * k * chi)
    return F.degrees(lam) + central, F.degrees(lat)

def utm_zone(lon: Column, lat: Column) -> Column:
    """1 to 60, negative in the south; with the wider zones of south-west Norway and Svalbard."""
    zone = F.floor((lon + 180.0) / 6.0).cast("int") + 1
    zone = F.when(zone > 60, 1).otherwise(zone)
    norway = lat.between(56.0, 63.9999999) & (lon >= 3.0) & (lon < 12.0)
    svalbard = (
        F.when((lon >= 0.0) & (lon < 9.0), 31).when((lon >= 9.0) & (lon < 21.0), 33).when((lon >= 21.0) & (lon < 33.0), 35).when((lon >= 33.0) & (lon < 42.0), 37)
    )
    zone = F.when(norway, 32).when((lat >= 72.0) & (lat < 84.0), F.coalesce(svalbard, zone)).otherwise(zone)
    return F.when(lat < 0, -zone).otherwise(zone)


def utm(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """(zone, easting, northing)."""
    zone = utm_zone(lon, lat)
    central = F.abs(zone) * 6.0 - 183.0
    x, y = transverse_mercator(lon, lat, central, north=F.when(zone < 0, 10000000.0).otherwise(0.0))
    return zone, x, y


def from_utm(zone: Column, x: Column, y: Column) -> tuple[Column, Column]:
    central = F.abs(zone) * 6.0 - 183.0
    return from_transverse_mercator(x, y, central, north=F.when(zone < 0, 10000000.0).otherwise(0.0))


def box_reprojected(boxes: DataFrame, keys: list[str], points: int = 100) -> DataFrame:
    """Geographic boxes to Web Mercator boxes by sampling each side at ``points`` + 1 places.

    A side over the date line is sampled eastwards from its west end, so its box
    holds places at both ends of the plane.
    """
    part = F.explode(F.sequence(F.lit(0), F.lit(points))).alias("k")
    w, s, e, n = map(F.col, ("west", "south", "east", "north"))
    rows = boxes.select(*keys, "west", "south", "east", "north", part)
    f = F.col("k") / float(points)
    x, y = geo.wrapped(w + f * F.when(w > e, e + 360.0 - w).otherwise(e - w)), s + f * (n - s)
    sides = F.array(*[F.struct(a.alias("lon"), b.alias("lat")) for a, b in ((x, s), (x, n), (w, y), (e, y))])
    places = rows.select(*keys, F.explode(sides).alias("p"))
    px, py = web_mercator(F.col("p.lon"), F.col("p.lat"))
    return places.select(*keys, px.alias("x"), py.alias("y")).groupBy(*keys).agg(F.min("x").alias("x_min"), F.min("y").alias("y_min"), F.max("x").alias("x_max"), F.max("y").alias("y_max"))
