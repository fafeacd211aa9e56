"""Spatial joins and boxes.

Points meet boxes over a grid of whole cells: boxes are spread to the cells that
they touch, points have one cell, and an equi-join on the cell is followed by the
exact test. Boxes over too many cells (near the poles they span all longitudes)
are spread over cells of a coarser grid instead, so no box is ever compared with
all points unless it covers most of the world. Points are copied only to the
grids that boxes use. The points of each cell are counted first; a cell with many
is split into as many parts as it needs, its points dealt to one of them each, its
boxes to all. So the largest share of a task doesn't grow with a crowded cell.

What is found is mostly the same for equal boxes and for things at one place. So
searches meet different boxes with different places, and ``expanded`` gives each
match to all that share it, without comparing or removing repeated pairs again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import arcs
from waymark.operators.lineage import checkpointed

#: Default distance in metres in which points of interest are looked for.
RADIUS = 1000.0
#: Cell sizes in degrees from fine to coarse, and cells that a box may touch before it goes to the next.
GRIDS = (0.02, 1.0, 30.0)
_MOST_CELLS = 64
#: Points that a part of a cell holds, and crowded cells that are broadcast at most.
CELL_POINTS = 1 << 17
_BROADCAST_CELLS = 100_000
#: Points up to which a table of them is broadcast to the boxes, and rows of a key that one part of it holds when matches are expanded.
BROADCAST_POINTS = 1 << 14
COPIES = 1 << 14
#: Rows of a key that are kept together when matches are expanded: enough for long runs, few enough to be found again by a file's compression.
BLOCK = 1 << 8
_SIDES = ("west", "south", "east", "north")


def _cells(west: Column, south: Column, east: Column, north: Column, size: float) -> Column:
    def span(low: Column, high: Column) -> Column:
        return F.sequence(F.floor(low / size).cast("int"), F.floor(high / size).cast("int"))

    return F.flatten(F.transform(span(west, east), lambda x: F.transform(span(south, north), lambda y: F.struct(x.alias("x"), y.alias("y")))))


def _grid_of(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Number of the finest grid on which a box touches few cells."""
    level = F.lit(len(GRIDS) - 1)
    for k in range(len(GRIDS) - 2, -1, -1):
        n = (F.floor(east / GRIDS[k]) - F.floor(west / GRIDS[k]) + 1) * (F.floor(north / GRIDS[k]) - F.floor(south / GRIDS[k]) + 1)
        level = F.when(n <= _MOST_CELLS, k).otherwise(level)
    return level


def _on_grids(boxes: DataFrame, prefix: str = "b") -> DataFrame:
    """Columns but the sides, the box as a struct, and its grid; a box over the date line becomes two."""
    names = [c for c in boxes.columns if c not in _SIDES]
    whole = boxes.select(*names, F.explode(geo.split_at_date_line(*map(F.col, _SIDES))).alias(prefix))
    return whole.withColumn("grid", _grid_of(*[F.col(f"{prefix}.{c}") for c in _SIDES]))


def _in_all_cells(level: DataFrame) -> DataFrame:
    """Boxes ``b`` once for each cell of their grid that they touch; two generators, as nested arrays of cells are slow to make."""
    size = F.element_at(F.array(*map(F.lit, GRIDS)), F.col("grid") + 1)

    def span(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(low) / size).cast("int"), F.floor(F.col(high) / size).cast("int")))

    columns = level.withColumn("\u0001x", span("b.west", "b.east")).withColumn("\u0001y", span("b.south", "b.north"))
    return columns.select(*level.columns, F.struct(F.col("\u0001x").alias("x"), F.col("\u0001y").alias("y")).alias("cell"))


def grids_of(boxes: DataFrame) -> list[int]:
    """The grids that boxes use, a job over the boxes alone."""
    return sorted(r["grid"] for r in _on_grids(boxes.select(*_SIDES)).select("grid").distinct().collect())  # at most three


def _in_cells(points: DataFrame, lon: str, lat: str, grids: Sequence[int]) -> DataFrame:
    """Points once for each grid, with grid and cell."""
    def place(k: int) -> Column:
        cell = F.struct(F.floor(F.col(lon) / GRIDS[k]).cast("int").alias("x"), F.floor(F.col(lat) / GRIDS[k]).cast("int").alias("y"))
        return F.struct(F.lit(k).alias("grid"), cell.alias("cell"))

    return points.select("*", F.explode(F.array(*map(place, grids))).alias("at")).select(*points.columns, "at.grid", "at.cell")


def crowded_cells(points: DataFrame, lon: str, lat: str, grids: Sequence[int], most: int = CELL_POINTS) -> DataFrame:
    """(grid, cell, parts) of the cells with more than ``most`` points, an aggregate over all points; there is at most one for ``most`` points a grid."""
    counts = _in_cells(points.select(lon, lat), lon, lat, grids).groupBy("grid", "cell").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > most).select("grid", "cell", F.ceil(F.col("n") / most).cast("int").alias("parts"))


def in_parts(points: DataFrame, crowded: DataFrame, lon: str, lat: str, grids: Sequence[int]) -> DataFrame:
    """Points in their cells and in one part of each, by all their columns."""
    names = [F.col(c) for c, kind in points.dtypes if not kind.startswith("map")]
    known = _in_cells(points, lon, lat, grids).join(crowded, ["grid", "cell"], "left")
    part = F.pmod(F.xxhash64(*names), F.coalesce("parts", F.lit(1))).cast("int")
    return known.withColumn("cell_part", part).drop("parts")


def boxes_with_points(boxes: DataFrame, points: DataFrame, lon: str = "lon", lat: str = "lat", grids: Sequence[int] | None = None, most: int = CELL_POINTS) -> DataFrame:
    """All columns of both for each point inside a closed box (west, south, east, north); boxes may cross the date line.

    Each row of one meets each row of the other once. ``grids``: those that the
    boxes use, by default looked up before the points are read; boxes of other
    grids would find nothing. ``most``: points that one part of a cell holds.
    Points up to ``BROADCAST_POINTS`` are broadcast, so boxes aren't shuffled.
    """
    few = min(BROADCAST_POINTS, most)
    is_few = points.limit(few + 1).count() <= few
    if grids is None:
        grids = range(len(GRIDS)) if is_few else grids_of(boxes)
    names = [c for c in boxes.columns if c not in _SIDES]
    level = _on_grids(boxes)
    if not grids:
        return level.select(*names).limit(0).crossJoin(points.limit(0))
    spread = _in_all_cells(level.where(F.col("grid").isin(*grids)))
    keys, inside = ["grid", "cell"], geo.holds({c: F.col(f"b.{c}") for c in _SIDES}, F.col(lon), F.col(lat))
    if is_few:
        # no cell is crowded, and boxes meet them where they are
        return spread.join(F.broadcast(_in_cells(points, lon, lat, grids)), keys).where(inside).drop(*keys, "b")
    crowded = checkpointed(crowded_cells(points, lon, lat, grids, most))
    n_crowded = crowded.count()
    crowded = F.broadcast(crowded) if n_crowded <= _BROADCAST_CELLS else crowded
    if n_crowded:
        parts = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
        spread = spread.join(crowded, keys, "left").withColumn("cell_part", F.explode(parts)).drop("parts")
        located, keys = in_parts(points, crowded, lon, lat, grids), [*keys, "cell_part"]
    else:
        located = _in_cells(points, lon, lat, grids)
    # a box's cells are different, a point has one cell of its grid, and halves at the date line share no point
    return spread.join(located, keys).where(inside).drop(*keys, "b")


def boxes_with_boxes(boxes: DataFrame, others: DataFrame) -> DataFrame:
    """All columns but the sides of both, for each pair of closed boxes that touch; both may cross the date line, and have no other names in common.

    The pair is made in the one cell where their common part begins, so it
    comes once. Grids are met from the coarser of both: a box goes to the cells
    of its own grid and of all coarser ones, tagged by which of the two is at
    home there.
    """
    a, b = _on_grids(boxes, "a"), _on_grids(others, "b")

    def spread(df: DataFrame, box: str) -> DataFrame:
        sides = [F.col(f"{box}.{c}") for c in _SIDES]

        def on_grid(k: int) -> Column:
            cells = F.transform(_cells(*sides, GRIDS[k]), lambda c: F.struct(F.lit(k).alias("on"), c.alias("cell")))
            return F.when(F.col("grid") <= k, cells).otherwise(F.array().cast("array<struct<on:int,cell:struct<x:int,y:int>>>"))

        return df.select("*", F.explode(F.concat(*map(on_grid, range(len(GRIDS))))).alias("at")).select("*", "at.on", "at.cell").drop("at")

    left, right = spread(a, "a").withColumnRenamed("grid", "grid_a"), spread(b, "b").withColumnRenamed("grid", "grid_b")
    one, two = ({c: F.col(f"{n}.{c}") for c in _SIDES} for n in ("a", "b"))
    begins = {"x": F.greatest(one["west"], two["west"]), "y": F.greatest(one["south"], two["south"])}
    size = F.element_at(F.array(*map(F.lit, GRIDS)), F.col("on") + 1)
    here = (F.floor(begins["x"] / size) == F.col("cell.x")) & (F.floor(begins["y"] / size) == F.col("cell.y"))
    met = left.join(right, ["on", "cell"]).where((F.col("on") == F.greatest("grid_a", "grid_b")) & here & geo.meets(one, two))
    return met.drop("on", "cell", "grid_a", "grid_b", "a", "b")


def densified(path: DataFrame, radius: float = RADIUS) -> DataFrame:
    """(track_id, lon, lat): points of paths; longer steps are cut on the great circle, and each segment's last point is added."""
    nxt = F.lead(F.struct("lon", "lat", "dist")).over(Window.partitionBy("track_id", "seg_no").orderBy("pt_no"))
    rows = path.select("track_id", F.col("lon").alias("lon0"), F.col("lat").alias("lat0"), "dist", nxt.alias("nxt"))
    parts = F.coalesce(F.greatest(F.ceil((F.col("nxt.dist") - F.col("dist")) / radius).cast("int"), F.lit(1)), F.lit(1))
    rows = rows.select("track_id", "lon0", "lat0", F.col("nxt.lon").alias("lon1"), F.col("nxt.lat").alias("lat1"), parts.alias("n"))
    cut = arcs.with_arc(rows, F.col("n") > 1).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("part", F.col("k") / F.col("n"))
    whole = F.col("k") == 0
    return arcs.placed(cut).select("track_id", F.when(whole, F.col("lon0")).otherwise(F.col("lon")).alias("lon"), F.when(whole, F.col("lat0")).otherwise(F.col("lat")).alias("lat"))


def in_blocks(rows: DataFrame, keys: list[str], most: int = BLOCK) -> DataFrame:
    """(keys, other columns as arrays): the rows of a key in blocks of at most ``most``, by their values; one pass over sorted rows."""
    rest = [c for c in rows.columns if c not in keys]
    order = [F.col(c) for c, kind in rows.dtypes if c in rest and not kind.startswith("map")] or [F.lit(0)]
    block = F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / most)
    # structs, since a list of a column would leave out its nulls
    blocks = rows.withColumn("\u0001block", block).groupBy(*keys, "\u0001block").agg(F.collect_list(F.struct(*rest)).alias("\u0001rows"))
    return blocks.select(*keys, *[F.col(f"\u0001rows.{c}").alias(c) for c in rest])


def expanded(hits: DataFrame, rows: DataFrame, keys: list[str], most: int = COPIES) -> DataFrame:
    """Columns of ``hits`` but the keys, and all columns of ``rows``, for each row that has the keys of a hit.

    Rows of a key with over ``most`` of them are dealt to as many parts as it
    needs, its hits go to all, so a key that very many share is the work of many
    tasks. Few and small rows can give very many, so tasks are as many as a
    shuffle's and aren't merged by the size of what they read. Rows of a key are
    held in blocks, each of which meets the hits one after the other, so only
    hits and blocks are written to disk or sorted; what is made repeats the
    values of a hit along a block, and the same block from hit to hit, which
    files of columns store in a few bits a row.
    """
    wanted = [*[c for c in hits.columns if c not in keys], *rows.columns]
    crowded = rows.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias("\u0001parts")).where(F.col("\u0001parts") > 1)
    crowded = checkpointed(crowded)
    n_crowded = crowded.count()
    left = {k: f"\u0001{k}" for k in keys}
    hits = hits.withColumnsRenamed(left)
    same = [F.col(a) == F.col(k) for k, a in left.items()]
    hit_part, own_part = F.lit(0), F.lit(0)
    if n_crowded:
        crowded = F.broadcast(crowded) if n_crowded <= _BROADCAST_CELLS else crowded
        parts = F.coalesce("\u0001parts", F.lit(1))
        hits = hits.join(crowded, same, "left").drop(*keys).withColumn("\u0001part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("\u0001parts")
        names = [F.col(c) for c, kind in rows.dtypes if not kind.startswith("map")]
        rows = rows.join(crowded, keys, "left").select(*rows.columns, F.pmod(F.xxhash64(*names), parts).cast("int").alias("\u0001own"))
        hit_part, own_part = F.col("\u0001part"), F.col("\u0001own")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # joined by one number for keys and part, as keys of floating numbers would be changed for the join and shuffled once more; then by the keys
    hits = hits.withColumn("\u0001at", F.xxhash64(*left.values(), hit_part)).drop("\u0001part").repartition(tasks, "\u0001at")
    rows = rows.dropna(subset=keys).withColumn("\u0001here", F.xxhash64(*keys, own_part)).drop("\u0001own").repartition(tasks, "\u0001here")
    one, *rest = [c for c in rows.columns if c not in ("\u0001here", *keys)] or ["\u0001one"]
    blocks = in_blocks(rows if one in rows.columns else rows.withColumn(one, F.lit(0)), ["\u0001here", *keys])
    # sorted on both sides: the blocks of a key are read one by one, its hits again for each
    met = blocks.hint("merge").join(hits, [F.col("\u0001here") == F.col("\u0001at"), *[F.col(a).between(F.col(k), F.col(k)) for k, a in left.items()]])
    given = [c for c in met.columns if c != one]
    met = met.select(*given, F.posexplode(one).alias("\u0001nth", one)) if rest else met.select(*given, F.explode(one).alias(one))
    return met.select(*[F.get(c, "\u0001nth").alias(c) if c in rest else c for c in wanted])


def _boxes_around(places: DataFrame, keys: list[str], radius: float) -> DataFrame:
    return places.select(*keys, *[c.alias(k) for k, c in geo.box_around(F.col("lon"), F.col("lat"), radius).items()])


def _spots(pois: DataFrame) -> DataFrame:
    return pois.select("lon", "lat").distinct()


def near_paths(path: DataFrame, pois: DataFrame, radius: float = RADIUS) -> DataFrame:
    """(track_id, poi columns): points of interest in a box of ``radius`` around any place of a path, once each; ``wpt_id`` tells them apart if there is one.

    Paths meet the places that points of interest have, once each; all those at a place are found with it.
    """
    boxes = _boxes_around(densified(path, radius), ["track_id"], radius)
    spots = boxes_with_points(boxes, _spots(pois)).select("track_id", "lon", "lat").distinct()
    if "wpt_id" not in pois.columns:
        return expanded(spots, pois.distinct(), ["lon", "lat"])
    # an id at several places is found once all the same
    twice = checkpointed(pois.groupBy("wpt_id").count().where("count > 1").select(F.col("wpt_id").alias("\u0001id")))
    if twice.isEmpty():
        return expanded(spots, pois, ["lon", "lat"])
    known = F.col("wpt_id").eqNullSafe(F.col("\u0001id"))
    once, more = (expanded(spots, pois.join(twice, known, how), ["lon", "lat"]) for how in ("left_anti", "left_semi"))
    return once.unionByName(more.dropDuplicates(["track_id", "wpt_id"]))


def near_points(places: DataFrame, pois: DataFrame, keys: list[str], radius: float = RADIUS) -> DataFrame:
    """Points of interest in the box around each place."""
    return boxes_with_points(_boxes_around(places, keys, radius), pois)


def near_any(places: DataFrame, pois: DataFrame, radius: float = RADIUS) -> DataFrame:
    """Points of interest in the box around at least one of many places; which of them isn't told, so no pairs are made."""
    spots = boxes_with_points(_boxes_around(places, [], radius), _spots(pois)).select("lon", "lat").distinct()
    return pois.join(spots, ["lon", "lat"], "left_semi")


def near_boxes(areas: DataFrame, pois: DataFrame, keys: list[str], radius: float = RADIUS) -> DataFrame:
    """Points of interest in each area's box grown by ``radius`` on all sides.

    Different boxes meet the places that points of interest have, and each match is given to all that share it.
    """
    margin = F.degrees(F.lit(radius / geo.EARTH_RADIUS))
    boxes = areas.select(*keys, *[c.alias(k) for k, c in geo.box_grown(geo.box_columns(), margin).items()])
    spots = boxes_with_points(_shapes(boxes), _spots(pois)).select("box", "lon", "lat")
    found = expanded(spots, boxes.select(*keys, F.struct(*_SIDES).alias("box")), ["box"]).drop("box")
    return expanded(found, pois, ["lon", "lat"])


def distinct_hits(*hits: DataFrame) -> DataFrame:
    """Union of points of interest found by several searches; equal name and place are one."""
    out = hits[0]
    for h in hits[1:]:
        out = out.unionByName(h)
    return out.dropDuplicates(["name", "lon", "lat"])


def enabled_only(pois: DataFrame, disabled_files: DataFrame) -> DataFrame:
    return pois.join(disabled_files.select("file"), "file", "left_anti")


def bounds(points: DataFrame, keys: list[str]) -> DataFrame:
    """Bounding box by key; rows without coordinates don't count."""
    return points.groupBy(*keys).agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))


def united(*boxes: DataFrame) -> DataFrame:
    """Box over boxes, with its centre; the date line isn't looked at, null boxes don't count."""
    out = boxes[0].select("west", "south", "east", "north")
    for b in boxes[1:]:
        out = out.unionByName(b.select("west", "south", "east", "north"))
    whole = out.agg(F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"))
    return whole.withColumns({"center_lon": (F.col("west") + F.col("east")) / 2, "center_lat": (F.col("south") + F.col("north")) / 2})


def box_union(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """Smallest box over two; a null one doesn't count."""
    return {
        "west": F.least(a["west"], b["west"]),
        "south": F.least(a["south"], b["south"]),
        "east": F.greatest(a["east"], b["east"]),
        "north": F.greatest(a["north"], b["north"]),
    }


def box_intersection(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """Common part of two boxes, nulls if they don't meet."""
    both = {
        "west": F.greatest(a["west"], b["west"]),
        "south": F.greatest(a["south"], b["south"]),
        "east": F.least(a["east"], b["east"]),
        "north": F.least(a["north"], b["north"]),
    }
    return {k: F.when(geo.meets(a, b), v) for k, v in both.items()}


def range_union(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    return F.least(a[0], b[0]), F.greatest(a[1], b[1])


def range_intersection(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    low, high = F.greatest(a[0], b[0]), F.least(a[1], b[1])
    return F.when(low <= high, low), F.when(low <= high, high)


def _shapes(boxes: DataFrame) -> DataFrame:
    """Different boxes, with the sides in a struct too."""
    return boxes.select(*_SIDES).distinct().withColumn("box", F.struct(*_SIDES))


def features_in_boxes(boxes: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, part): features that show in each box.

    Nodes and closed ways show by their point (a closed way by the centre of its
    box), open ways where their boxes meet. ``keys`` identify a box. Different
    boxes meet different places and boxes of features, and each match is given
    to all that share it.
    """
    middle = features.where("kind = 'way' and closed").select("id", ((F.col("west") + F.col("east")) / 2).alias("lon"), ((F.col("south") + F.col("north")) / 2).alias("lat"))
    named = boxes.select(*keys, F.struct(*_SIDES).alias("box"))
    shapes = _shapes(boxes)

    def found(points: DataFrame, part: str) -> DataFrame:
        # one part at a time, so that blocks are lists of ids only
        spots = expanded(boxes_with_points(shapes, _spots(points)).select("box", "lon", "lat"), named, ["box"]).drop("box")
        return expanded(spots, points, ["lon", "lat"]).select(*keys, "id", F.lit(part).alias("part"))

    by_point = found(features.where("kind = 'node'").select("id", "lon", "lat"), "point").unionByName(found(middle, "area"))
    ways = features.where("kind = 'way' and not closed").select("id", *_SIDES).distinct()
    met = boxes_with_boxes(shapes, _shapes(ways).withColumnRenamed("box", "shape")).select("box", "shape").distinct()
    by_box = expanded(met, named.distinct(), ["box"]).drop("box")
    by_box = expanded(by_box, ways.select("id", F.struct(*_SIDES).alias("shape")), ["shape"]).select(*keys, "id", F.lit("path").alias("part"))
    return by_point.unionByName(by_box)


def features_counted(boxes: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, inside, touching): how many features have their point in each box, and how many have a box that meets it; boxes that meet none are left out.

    Different boxes are counted once, over different features with their number.
    """
    alike = features.groupBy("lon", "lat", *_SIDES).agg(F.count("*").alias("n"))
    met = boxes_with_boxes(_shapes(boxes), alike)
    inside = F.exists(geo.split_at_date_line(*[F.col(f"box.{c}") for c in _SIDES]), lambda b: geo.holds({c: b[c] for c in _SIDES}, F.col("lon"), F.col("lat")))
    counts = met.groupBy("box").agg(F.sum(F.when(inside, F.col("n")).otherwise(0)).alias("inside"), F.sum("n").alias("touching"))
    named = boxes.select(*keys, F.struct(*_SIDES).alias("box")).join(counts, "box")
    return named.groupBy(*keys).agg(F.sum("inside").alias("inside"), F.sum("touching").alias("touching"))


def charts_then_features(boxes: DataFrame, charts: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    """Features of those charts only that meet a box: charts (chart_id and a box), features with chart_id.

    Different boxes meet the different places of each chart's features, and each match is given to all that share it.
    """
    shapes = _shapes(boxes)
    met = boxes_with_boxes(shapes, charts.select("chart_id", *_SIDES)).select("box", "chart_id").distinct()
    spots = boxes_with_points(shapes, features.select("chart_id", "lon", "lat").distinct()).select("box", "chart_id", "lon", "lat")
    found = expanded(spots.join(met, ["box", "chart_id"], "left_semi"), boxes.select(*keys, F.struct(*_SIDES).alias("box")).distinct(), ["box"]).drop("box")
    return expanded(found, features, ["chart_id", "lon", "lat"]).select(*keys, "chart_id", "id")


def missing_tiles(boxes: DataFrame, inventory: DataFrame) -> DataFrame:
    """1 degree tiles that boxes need and the inventory (tile_lon, tile_lat) lacks."""
    from waymark.functions.tiles import degree_tiles

    need = boxes.select(F.explode(degree_tiles(*map(F.col, ("west", "south", "east", "north")))).alias("n")).select("n.tile_lon", "n.tile_lat").distinct()
    return need.join(inventory, ["tile_lon", "tile_lat"], "left_anti")


def boxes_with_terrain(boxes: DataFrame, inventory: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes that at least one tile of the inventory touches."""
    from waymark.functions.tiles import degree_tiles

    need = boxes.select(*keys, F.explode(degree_tiles(*map(F.col, ("west", "south", "east", "north")))).alias("n")).select(*keys, "n.tile_lon", "n.tile_lat")
    return need.join(inventory, ["tile_lon", "tile_lat"], "left_semi").select(*keys).distinct()
