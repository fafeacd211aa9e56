"""Terrain rasters as tables: one row a sample (tile_lon, tile_lat, samples, row, col, z); row 0 is the south edge, null is no data."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Light for hill shading: compass direction and height in degrees, exaggeration, ambient part, strongest shade.
AZIMUTH, ALTITUDE, EXAGGERATION, AMBIENT, ALPHA = 315.0, 45.0, 0.6, 0.2, 96
_TILE = ("tile_lon", "tile_lat")


def elevations(places: DataFrame, dem: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, elevation): bilinear between the four samples around each place; null if one is missing.

    ``keys`` identify a place. Only the sample rows asked for are joined.
    """
    sizes = dem.groupBy(*_TILE).agg(F.max("samples").alias("samples"))
    located = places.select(*keys, F.floor("lon").cast("int").alias("tile_lon"), F.floor("lat").cast("int").alias("tile_lat"), "lon", "lat").join(sizes, list(_TILE), "left")
    y = (F.col("lat") - F.col("tile_lat")) * (F.col("samples") - 1)
    x = (F.col("lon") - F.col("tile_lon")) * (F.col("samples") - 1)
    cut = located.withColumns({"y": y, "x": x}).withColumns({"row": F.floor("y").cast("int"), "col": F.floor("x").cast("int")})
    corners = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr in (0, 1) for dc in (0, 1)])
    wanted = cut.select(*keys, *_TILE, (F.col("x") - F.col("col")).alias("fx"), (F.col("y") - F.col("row")).alias("fy"), "row", "col", F.explode(corners).alias("k"))
    wanted = wanted.withColumns({"row": F.col("row") + F.col("k.dr"), "col": F.col("col") + F.col("k.dc")})
    found = wanted.join(dem.select(*_TILE, "row", "col", "z"), [*_TILE, "row", "col"], "left")
    weight = F.when(F.col("k.dc") == 1, F.col("fx")).otherwise(1.0 - F.col("fx")) * F.when(F.col("k.dr") == 1, F.col("fy")).otherwise(1.0 - F.col("fy"))
    all_there = F.count("z") == 4
    return found.groupBy(*keys).agg(F.when(all_there, F.sum(weight * F.col("z"))).alias("elevation"))


def with_halo(dem: DataFrame) -> DataFrame:
    """Samples with a rim of one sample from the neighbour tiles, whose edges repeat each other's samples."""
    n = F.col("samples")
    last, out = n - 1, dem.select(*_TILE, "samples", "row", "col", "z")

    def shifted(dx: int, dy: int) -> DataFrame:
        # samples next to a tile's edge lie outside the neighbour's edge
        row = F.col("row") if dy == 0 else F.when(F.lit(dy > 0), F.lit(-1)).otherwise(n)
        col = F.col("col") if dx == 0 else F.when(F.lit(dx > 0), F.lit(-1)).otherwise(n)
        near_row = F.lit(True) if dy == 0 else F.col("row") == (last - 1 if dy > 0 else F.lit(1))
        near_col = F.lit(True) if dx == 0 else F.col("col") == (last - 1 if dx > 0 else F.lit(1))
        return dem.where(near_row & near_col).select(
            (F.col("tile_lon") + dx).alias("tile_lon"), (F.col("tile_lat") + dy).alias("tile_lat"), "samples", row.alias("row"), col.alias("col"), "z"
        )

    for dx in (-1, 0, 1):
        for dy in (-1, 0, 1):
            if dx or dy:
                out = out.unionByName(shifted(dx, dy))
    return out


def _stencil(dem: DataFrame) -> tuple[DataFrame, dict[tuple[int, int], Column]]:
    """Adds the neighbours of each sample; keys are (rows north, columns east)."""
    across = Window.partitionBy(*_TILE, "row").orderBy("col")
    along = Window.partitionBy(*_TILE, "col").orderBy("row")
    near = dem.withColumns({"left": F.lag("z").over(across), "right": F.lead("z").over(across)})
    mine = F.struct("z", "left", "right")
    near = near.withColumns({"north": F.lead(mine).over(along), "south": F.lag(mine).over(along)})
    cells = {(0, -1): F.col("left"), (0, 1): F.col("right")}
    for name, k in (("north", 1), ("south", -1)):
        cells |= {(k, -1): F.col(f"{name}.left"), (k, 0): F.col(f"{name}.z"), (k, 1): F.col(f"{name}.right")}
    return near, cells


def hill_shade(dem: DataFrame, halo: bool = False) -> DataFrame:
    """(tile, row, col, light, shade): illumination of each inner sample by Horn's derivatives; null light shades 0.

    With ``halo`` the rims of tiles take their neighbours from other tiles;
    samples without all eight neighbours have no row.
    """
    source = with_halo(dem) if halo else dem
    near, c = _stencil(source)
    dzdx = EXAGGERATION * (c[1, 1] + 2 * c[0, 1] + c[-1, 1] - c[1, -1] - 2 * c[0, -1] - c[-1, -1]) / 8.0
    dzdy = EXAGGERATION * (c[1, -1] + 2 * c[1, 0] + c[1, 1] - c[-1, -1] - 2 * c[-1, 0] - c[-1, 1]) / 8.0
    alpha, beta = math.radians(AZIMUTH), math.radians(ALTITUDE)
    a1, a2, a3 = math.sin(beta), math.cos(beta) * math.sin(alpha), math.cos(beta) * math.cos(alpha)
    rows = near.withColumns({"dzdx": dzdx, "dzdy": dzdy})
    raw = (a1 - a2 * F.col("dzdx") - a3 * F.col("dzdy")) / F.sqrt(1.0 + F.col("dzdx") * F.col("dzdx") + F.col("dzdy") * F.col("dzdy"))
    lit = raw * (1.0 - AMBIENT) + AMBIENT
    light = F.when(lit >= 0, F.sqrt(lit)).when(lit < 0, 0.0)
    n = F.col("samples")
    inner = F.col("row").between(0, n - 1) & F.col("col").between(0, n - 1) if halo else F.col("row").between(1, n - 2) & F.col("col").between(1, n - 2)
    out = rows.withColumn("light", light).where(inner)
    return out.select(*_TILE, "row", "col", "light", F.coalesce(ALPHA - F.floor(F.col("light") * ALPHA), F.lit(0)).cast("int").alias("shade"))


def box_sizes(sigma: float, n: int = 3) -> list[int]:
    """Odd widths of ``n`` box filters that together come near a Gaussian."""
    ideal = math.sqrt(12.0 * sigma * sigma / n + 1.0)
    small = math.floor(ideal)
    small -= 1 - small % 2
    m = math.floor((12.0 * sigma * sigma - n * small * small - 4 * n * small - 3 * n) / (-4.0 * small - 4.0) + 0.5)
    return [small if i < m else small + 2 for i in range(n)]


def _box_mean(df: DataFrame, values: list[str], along: str, across: str, half: int) -> DataFrame:
    """Mean over 2 half + 1 samples along one axis; beyond the edges the edge sample repeats."""
    group = Window.partitionBy(*_TILE, across)
    order = group.orderBy(along)
    place, n = F.row_number().over(order) - 1, F.count("*").over(group)
    out = df.withColumns({"i": place, "n": n})
    new = {}
    for v in values:
        inside = F.sum(v).over(order.rowsBetween(-half, half))
        first, last = F.first(v).over(order), F.last(v).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        before, after = F.greatest(F.lit(half) - F.col("i"), F.lit(0)), F.greatest(F.col("i") + half - F.col("n") + 1, F.lit(0))
        new[v] = (inside + before * first + after * last) / float(2 * half + 1)
    return out.withColumns(new).drop("i", "n")


def blurred(dem: DataFrame, radius: int) -> DataFrame:
    """(tile, row, col, z) blurred by three box means by column and row; missing samples don't count and stay missing."""
    out = dem.select(*_TILE, "row", "col", F.coalesce(F.col("z").cast("double"), F.lit(0.0)).alias("sum"), F.col("z").isNotNull().cast("double").alias("there"), F.col("z").isNull().alias("gone"))
    for size in box_sizes(radius):
        half = (size - 1) // 2
        out = _box_mean(out, ["sum", "there"], "col", "row", half)
        out = _box_mean(out, ["sum", "there"], "row", "col", half)
    return out.select(*_TILE, "row", "col", F.when(~F.col("gone"), F.try_divide("sum", "there")).alias("z"))
