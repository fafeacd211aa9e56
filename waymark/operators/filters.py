"""Attribute filters and rules on map features, compiled to columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attribute_filter(spec: Sequence, tags: Column, geometry: Column | None = None) -> Column:
    """A filter like ["all", ["==", "brand", "x"], ["!has", "size"]] as a Boolean column, never null.

    A missing key fails every test but !=, !in and !has. ``$type`` is the kind of
    geometry. Numbers compare as numbers, texts as texts.
    """
    if not spec:
        return F.lit(True)
    op, *rest = spec
    if op in ("all", "any"):
        parts = [attribute_filter(s, tags, geometry) for s in rest]
        return reduce(lambda a, b: a & b if op == "all" else a | b, parts, F.lit(op == "all"))
    if op == "none":
        return ~attribute_filter(["any", *rest], tags, geometry)
    key, *values = rest
    value = geometry if key == "$type" and geometry is not None else tags[key]
    if op in ("has", "!has"):
        there = F.coalesce(value.isNotNull(), F.lit(False))
        return there if op == "has" else ~there

    def test(wanted, compare) -> Column:
        left = value.try_cast("double") if isinstance(wanted, (int, float)) and not isinstance(wanted, bool) else value
        right = F.lit(str(wanted).lower() if isinstance(wanted, bool) else wanted)
        return F.coalesce(compare(left, right), F.lit(False))

    if op in ("in", "!in"):
        found = reduce(lambda a, b: a | b, [test(v, lambda x, y: x == y) for v in values], F.lit(False))
        return found if op == "in" else ~found
    compare = {
        "==": lambda x, y: x == y,
        "!=": lambda x, y: x == y,
        "<": lambda x, y: x < y,
        "<=": lambda x, y: x <= y,
        ">": lambda x, y: x > y,
        ">=": lambda x, y: x >= y,
    }[op]
    found = test(values[0], compare)
    return ~found if op == "!=" else found


def zoom_window(zoom: Column, low: int, high: int) -> Column:
    """From low up to high, high excluded; negative zooms always fit."""
    return (zoom < 0) | ((zoom >= low) & (zoom < high))


@dataclass(frozen=True)
class TagTest:
    """Keys and values, each with * for any. Key and value may be those of different tags.

    ``exclude``: no tag has one of the keys, or a value that isn't listed.
    ``negated``: true without a matching key.
    """

    keys: tuple[str, ...]
    values: tuple[str, ...]
    exclude: bool = False
    negated: bool = False

    def matches(self, tags: Column) -> Column:
        def some(array: Column, wanted: tuple[str, ...]) -> Column:
            return F.lit(True) if "*" in wanted else F.arrays_overlap(array, F.array(*map(F.lit, wanted)))

        has_key, has_value = some(F.map_keys(tags), self.keys), some(F.map_values(tags), self.values)
        value = ~has_value if self.exclude else has_value
        if self.negated:
            return F.when(~has_key, True).otherwise(value)
        return value if self.exclude else has_key & value


@dataclass(frozen=True)
class Rule:
    """What a rule needs: kind (node, way or any), closed (None: either), zooms, and all of its tests."""

    name: str
    kind: str = "any"
    closed: bool | None = None
    zooms: tuple[int, int] = (0, 127)
    tests: tuple[TagTest, ...] = field(default=())

    def matches(self, kind: Column, closed: Column, zoom: Column, tags: Column) -> Column:
        out = (zoom >= self.zooms[0]) & (zoom <= self.zooms[1])
        if self.kind != "any":
            out &= kind == self.kind
        if self.closed is not None:
            out &= closed == self.closed
        for test in self.tests:
            out &= test.matches(tags)
        return F.coalesce(out, F.lit(False))


def _matching(rules: Sequence[Rule], zoom: Column) -> Column:
    hits = [
        F.when(r.matches(F.col("kind"), F.col("closed"), zoom, F.col("tags")), F.struct(F.lit(i).alias("priority"), F.lit(r.name).alias("rule")))
        for i, r in enumerate(rules)
    ]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def all_matches(features: DataFrame, rules: Sequence[Rule], zoom: int) -> DataFrame:
    """(id, priority, rule) of every rule that a feature meets; a list of rules is a few hundred at most."""
    return features.select("id", F.explode(_matching(rules, F.lit(zoom))).alias("m")).select("id", "m.priority", "m.rule")


def first_match(features: DataFrame, rules: Sequence[Rule], zoom: int) -> DataFrame:
    """(id, rule) of the first rule that a feature meets; the rest are left out."""
    found = features.select("id", F.try_element_at(_matching(rules, F.lit(zoom)), F.lit(1)).alias("m"))
    return found.where("m is not null").select("id", "m.rule")


def visible_categories(layers: dict[str, dict], layer: str) -> list[str]:
    """Categories of a layer, its parents and its enabled overlays; ``layers``: name to categories, parent, overlays, enabled."""
    found: list[str] = []
    seen: set[str] = set()
    todo = [layer]
    while todo:
        name = todo.pop(0)
        if name in seen or name not in layers:
            continue
        seen.add(name)
        entry = layers[name]
        found += [c for c in entry.get("categories", ()) if c not in found]
        if entry.get("parent"):
            todo.append(entry["parent"])
        todo += [o for o in entry.get("overlays", ()) if layers.get(o, {}).get("enabled")]
    return found


def covers_schema(style_layers: Column, tile_layers: Column) -> Column:
    """All layers that a style reads are there."""
    return F.size(F.array_except(style_layers, tile_layers)) == 0


#: Chart usage bands and their zooms: overview, general, coastal, approach, harbour, berthing.
USAGE_BANDS = ((1, 6, 7), (2, 8, 9), (3, 10, 11), (4, 12, 13), (5, 14, 18), (6, 19, 19))


def usage_zooms(band: Column) -> Column:
    """struct<low, high> of a usage band, null for an unknown one."""
    out = F.lit(None).cast("struct<low:int,high:int>")
    for b, low, high in USAGE_BANDS:
        out = F.when(band == b, F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"))).otherwise(out)
    return out


def zoom_function(stops: Sequence[tuple[float, float]], zoom: Column, base: float = 1.0) -> Column:
    """Piecewise value by zoom: exponential between stops, the first and last value outside."""
    out = F.lit(float(stops[-1][1]))
    for (z0, v0), (z1, v1) in reversed(list(zip(stops, stops[1:], strict=False))):
        gap = z1 - z0
        if gap < 1e-6:
            part = F.lit(0.0)
        elif base == 1.0:
            part = (zoom - z0) / gap
        else:
            part = (F.pow(F.lit(base), zoom - z0) - 1.0) / (base**gap - 1.0)
        out = F.when(zoom < z1, v0 * (1.0 - part) + v1 * part).otherwise(out)
    return F.when(zoom <= stops[0][0], float(stops[0][1])).otherwise(out)


def zoom_steps(stops: Sequence[tuple[float, object]], zoom: Column) -> Column:
    """The value of the last stop not above the zoom, before the first stop its value."""
    out = F.lit(stops[0][1])
    for z, v in stops:
        out = F.when(zoom >= z, F.lit(v)).otherwise(out)
    return out


def stroke_scale(zoom: Column) -> Column:
    """1.5 to the zooms above 12."""
    return F.when(zoom >= 12, F.pow(F.lit(1.5), zoom - 12)).otherwise(1.0)


def one_label_each(labels: DataFrame, text: str, order: list[Column]) -> DataFrame:
    """The first label of each text."""
    from pyspark.sql import Window

    return labels.withColumn("nth", F.row_number().over(Window.partitionBy(text).orderBy(*order))).where("nth = 1").drop("nth")
