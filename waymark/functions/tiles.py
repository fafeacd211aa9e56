"""Web Mercator tiles: addresses, zooms and ids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions.geo import EARTH_RADIUS

TILE_SIZE = 256


def _two_to(z: Column) -> Column:
    return F.pow(F.lit(2.0), z)


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees of the Mercator plane: longitude, and latitude stretched to the same scale."""
    return lon, F.degrees(F.log(F.tan(F.radians(F.lit(45.0) + lat / 2.0))))


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return x, F.degrees(2.0 * F.atan(F.exp(F.radians(y))) - F.lit(1.5707963267948966))


def tile_of(x: Column, y: Column, zoom: Column) -> tuple[Column, Column]:
    """(column, row) of the tile with a Mercator point; the last column and row hold the far edges."""
    last = _two_to(zoom) - 1.0

    def index(v: Column) -> Column:
        return F.least(F.greatest(F.floor(v / 360.0 * _two_to(zoom)).cast("double"), F.lit(0.0)), last).cast("long")

    return index(x + 180.0), index(180.0 - y)


def tile_corner(column: Column, row: Column, zoom: Column) -> tuple[Column, Column]:
    """Mercator degrees of the upper left corner."""
    return column * 360.0 / _two_to(zoom) - 180.0, F.lit(180.0) - row * 360.0 / _two_to(zoom)


def zoom_to_scale(zoom: Column, tile_size: int = TILE_SIZE) -> Column:
    """Mercator degrees a pixel."""
    return F.lit(360.0) / (_two_to(zoom) * float(tile_size))


def scale_to_zoom(scale: Column, tile_size: int = TILE_SIZE) -> Column:
    return F.floor(F.log2(F.lit(360.0) / (scale * float(tile_size))) + 1e-6).cast("int")


def ground_resolution(lat: Column, scale: Column) -> Column:
    """Metres a pixel at a latitude."""
    return F.radians(F.lit(1.0)) * EARTH_RADIUS * scale * F.cos(F.radians(lat))


def flipped_row(row: Column, zoom: Column) -> Column:
    """Row counted from the other edge."""
    return (_two_to(zoom) - row - 1.0).cast("long")


def inverted_zoom(zoom: Column) -> Column:
    return F.lit(17) - zoom


def packed_key(column: Column, row: Column, zoom: Column) -> Column:
    """((z << z) + x << z) + y."""
    side = _two_to(zoom).cast("long")
    return (zoom.cast("long") * side + column) * side + row


def quadkey(column: Column, row: Column, zoom: Column) -> Column:
    """One digit a zoom level, the coarsest first; empty at zoom 0."""

    def digit(level: Column) -> Column:
        bit = F.call_function("shiftright", column, (zoom - level).cast("int")).bitwiseAND(F.lit(1).cast("long"))
        bit2 = F.call_function("shiftright", row, (zoom - level).cast("int")).bitwiseAND(F.lit(1).cast("long"))
        return (bit + 2 * bit2).cast("string")

    levels = F.when(zoom > 0, F.sequence(F.lit(1), F.greatest(zoom.cast("int"), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(levels, digit), "")


def hilbert_id(column: Column, row: Column, zoom: Column) -> Column:
    """Tiles of all lower zooms, then the place on the zoom's Hilbert curve."""
    before = ((F.pow(F.lit(4.0), zoom) - 1.0) / 3.0).cast("long")
    zero = F.lit(0).cast("long")
    levels = F.when(zoom > 0, F.sequence(zoom.cast("int") - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))

    def step(acc: Column, level: Column) -> Column:
        side = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        right, low = acc.x.bitwiseAND(side) != 0, acc.y.bitwiseAND(side) != 0
        quarter = F.when(right & ~low, 3).when(right & low, 2).when(~right & low, 1).otherwise(0)
        # the lower quarters of the curve run transposed, the last one also mirrored
        x = F.when(low, acc.x).when(right, side - 1 - acc.x.bitwiseAND(side - 1)).otherwise(acc.x)
        y = F.when(low, acc.y).when(right, side - 1 - acc.y.bitwiseAND(side - 1)).otherwise(acc.y)
        new_x, new_y = F.when(low, x).otherwise(y), F.when(low, y).otherwise(x)
        return F.struct(new_x.alias("x"), new_y.alias("y"), (acc.d + side * side * quarter).alias("d"))

    start = F.struct(column.cast("long").alias("x"), row.cast("long").alias("y"), zero.alias("d"))
    return before + F.aggregate(levels, start, step, lambda acc: acc.d)


def degree_tile_name(lon: Column, lat: Column) -> Column:
    """File name of the 1 degree terrain tile whose lower left corner is (lon, lat)."""
    return F.format_string(
        "%s%02d%s%03d.hgt",
        F.when(lat < 0, "S").otherwise("N"),
        F.abs(lat).cast("int"),
        F.when(lon < 0, "W").otherwise("E"),
        F.abs(lon).cast("int"),
    )


def degree_tiles(west: Column, south: Column, east: Column, north: Column) -> Column:
    """array<struct<tile_lon, tile_lat>> of the 1 degree tiles that a box touches; over the date line tile 179 is next to tile -180."""

    def span(low: Column, high: Column) -> Column:
        return F.sequence(F.floor(low).cast("int"), F.floor(high).cast("int"))

    columns = F.when(west > east, F.concat(span(west, F.lit(179.0)), span(F.lit(-180.0), east))).otherwise(span(west, east))
    return F.flatten(F.transform(columns, lambda x: F.transform(span(south, north), lambda y: F.struct(x.alias("tile_lon"), y.alias("tile_lat")))))
