"""Geometry on the sphere as column expressions; degrees in, degrees or metres out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius in metres of the sphere on which distances are measured.
EARTH_RADIUS = 6378137.0
#: One nautical mile and 3.2 m: steps longer than this are drawn along the great circle.
LONG_STEP = 1855.3248
_ANTIPODE_NUDGE = 1e-5


def valid(lon: Column, lat: Column) -> Column:
    return F.coalesce(lon.between(-180, 180) & lat.between(-90, 90) & ~F.isnan(lon) & ~F.isnan(lat), F.lit(False))


def no_nan(value: Column) -> Column:
    """NaN becomes null."""
    return F.when(~F.isnan(value), value)


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Haversine distance in metres; null if a coordinate is."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    chord = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    return F.atan2(F.sqrt(chord), F.sqrt(1.0 - chord)) * (2.0 * EARTH_RADIUS)


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column, part: Column) -> tuple[Column, Column]:
    """(lon, lat) at ``part`` (0 to 1) of the great circle; antipodes are moved apart a little, equal points stay."""
    return along(arc(lon1, lat1, lon2, lat2), lon1, lat1, part)


def arc(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> dict[str, Column]:
    """What is the same at all places of a great circle: its angle and sine, and both ends as unit vectors."""
    opposite = (lat1 + lat2 == 0.0) & (F.abs(lon1 - lon2) == 180.0)
    polar = opposite & (lat1 == -90.0)
    lat2 = F.when(opposite, lat2 + F.when(polar, -_ANTIPODE_NUDGE).otherwise(_ANTIPODE_NUDGE)).otherwise(lat2)
    lon2 = F.when(opposite, lon2 - F.signum(lon2 - lon1) * _ANTIPODE_NUDGE).otherwise(lon2)
    a_lat, b_lat, a_lon, b_lon = F.radians(lat1), F.radians(lat2), F.radians(lon1), F.radians(lon2)
    s = F.pow(F.sin((b_lat - a_lat) / 2), 2) + F.cos(a_lat) * F.cos(b_lat) * F.pow(F.sin((b_lon - a_lon) / 2), 2)
    angle = 2.0 * F.asin(F.least(F.sqrt(s), F.lit(1.0)))

    def vector(lon: Column, lat: Column, name: str) -> dict[str, Column]:
        return {f"{name}x": F.cos(lat) * F.cos(lon), f"{name}y": F.cos(lat) * F.sin(lon), f"{name}z": F.sin(lat)}

    return {"angle": angle, "sine": F.nullif(F.sin(angle), F.lit(0.0)), **vector(a_lon, a_lat, "a"), **vector(b_lon, b_lat, "b")}


def along(arc: dict[str, Column], lon1: Column, lat1: Column, part: Column) -> tuple[Column, Column]:
    """(lon, lat) at ``part`` of an arc that starts at (lon1, lat1)."""
    from_a, from_b = F.sin((1.0 - part) * arc["angle"]) / arc["sine"], F.sin(part * arc["angle"]) / arc["sine"]
    x, y, z = (from_a * arc[f"a{c}"] + from_b * arc[f"b{c}"] for c in "xyz")
    lon, lat = F.degrees(F.atan2(y, x)), F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))
    return F.coalesce(lon, lon1), F.coalesce(lat, lat1)


def box_around(lon: Column, lat: Column, radius: Column | float) -> dict[str, Column]:
    """west, south, east, north of the box that holds all within ``radius`` metres.

    West is greater than east across the date line. With a pole inside, the box
    spans all longitudes.
    """
    angle = F.lit(radius) / EARTH_RADIUS if not isinstance(radius, Column) else radius / EARTH_RADIUS
    south, north = F.radians(lat) - angle, F.radians(lat) + angle
    polar = (south <= F.radians(F.lit(-90.0))) | (north >= F.radians(F.lit(90.0)))
    reach = F.asin(F.least(F.sin(angle) / F.cos(F.radians(lat)), F.lit(1.0)))
    west, east = F.degrees(F.radians(lon) - reach), F.degrees(F.radians(lon) + reach)
    return {
        "west": F.when(polar, -180.0).otherwise(F.when(west < -180.0, west + 360.0).otherwise(west)),
        "south": F.when(polar, F.greatest(F.degrees(south), F.lit(-90.0))).otherwise(F.degrees(south)),
        "east": F.when(polar, 180.0).otherwise(F.when(east > 180.0, east - 360.0).otherwise(east)),
        "north": F.when(polar, F.least(F.degrees(north), F.lit(90.0))).otherwise(F.degrees(north)),
    }


def wrapped(lon: Column) -> Column:
    """IEEE remainder by 360: -180 to 180."""
    return lon - 360.0 * F.rint(lon / 360.0)


def box_grown(box: dict[str, Column], margin: Column | float) -> dict[str, Column]:
    """The box with ``margin`` degrees more on each side; longitudes wrap, latitudes stop at the poles."""
    margin = margin if isinstance(margin, Column) else F.lit(margin)
    return {
        "west": wrapped(box["west"] - margin),
        "south": F.greatest(box["south"] - margin, F.lit(-90.0)),
        "east": wrapped(box["east"] + margin),
        "north": F.least(box["north"] + margin, F.lit(90.0)),
    }


def box_width(west: Column, east: Column) -> Column:
    """Across the date line: 360 less the difference of the sides as stored."""
    return F.when(west > east, 360.0 - (west - east)).otherwise(east - west)


def box_area(west: Column, south: Column, east: Column, north: Column) -> Column:
    return box_width(west, east) * (north - south)


def split_at_date_line(west: Column, south: Column, east: Column, north: Column) -> Column:
    """array of one or two boxes none of which crosses the date line."""

    def box(w, e):
        return F.struct(w.alias("west"), south.alias("south"), e.alias("east"), north.alias("north"))

    return F.when(west > east, F.array(box(west, F.lit(180.0)), box(F.lit(-180.0), east))).otherwise(F.array(box(west, east)))


def holds(box: dict[str, Column], lon: Column, lat: Column) -> Column:
    return (lon >= box["west"]) & (lon <= box["east"]) & (lat >= box["south"]) & (lat <= box["north"])


def meets(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Closed boxes touch or overlap."""
    return (a["east"] >= b["west"]) & (a["west"] <= b["east"]) & (a["north"] >= b["south"]) & (a["south"] <= b["north"])


def date_line_crossing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Latitude where a step of over 180 degrees of longitude crosses the date line, else null."""
    shifted1, shifted2 = F.when(lon1 < 0, lon1 + 360.0).otherwise(lon1), F.when(lon2 < 0, lon2 + 360.0).otherwise(lon2)
    at = lat1 + (180.0 - shifted1) * (lat2 - lat1) / F.nullif(shifted2 - shifted1, F.lit(0.0))
    return F.when(F.abs(lon2 - lon1) > 180.0, at)


def box_columns(names: Sequence[str] = ("west", "south", "east", "north")) -> dict[str, Column]:
    return dict(zip(("west", "south", "east", "north"), map(F.col, names), strict=True))
