"""Running values along ordered groups of any size: a scan of two levels.

A group is cut into parts (ranges of points, splits of a file), each of which is
one window partition. A part is reduced to one row; windows over these rows carry
sums, last values and neighbours along the group, and come back to the part's rows
by a join. So a single group is the work of many tasks, and only one row a part
of it is ever together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def of_part(name: str) -> Column:
    """A value of a reduced part, in the windows over parts."""
    return F.col(f"\u0001{name}")


def plus(carry: Column, own: Column) -> Column:
    """Sum of what is there, as a running sum has it: null only if both are."""
    return F.coalesce(carry + own, carry, own)


@dataclass(frozen=True)
class Scan:
    """Groups by ``group``, cut into parts that order like ``part``, rows by ``order``; none of these may be null."""

    group: tuple[str, ...]
    part: str
    order: str

    @property
    def keys(self) -> list[str]:
        return [*self.group, self.part]

    def inside(self) -> WindowSpec:
        """Along a part."""
        return Window.partitionBy(*self.keys).orderBy(self.order)

    def so_far(self) -> WindowSpec:
        return self.inside().rowsBetween(Window.unboundedPreceding, 0)

    def along(self) -> WindowSpec:
        """Over reduced parts, along a group."""
        return Window.partitionBy(*self.group).orderBy(self.part)

    def before(self) -> WindowSpec:
        return self.along().rowsBetween(Window.unboundedPreceding, -1)

    def after(self) -> WindowSpec:
        return self.along().rowsBetween(1, Window.unboundedFollowing)

    def whole(self) -> WindowSpec:
        """Over all parts of a group."""
        return self.along().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def last(self, value: Column) -> Column:
        """Last value of a part that isn't null."""
        return F.max_by(value, F.when(value.isNotNull(), F.col(self.order)))

    def carried(self, rows: DataFrame, reduced: dict[str, Column], *stages: dict[str, Column]) -> DataFrame:
        """Add to each row what the last of ``stages``, windows over parts, makes of ``reduced``, aggregates of each part.

        Stages before the last add to the parts; ``of_part`` names what a part has.
        """
        parts = rows.groupBy(*self.keys).agg(*[c.alias(f"\u0001{k}") for k, c in reduced.items()])
        for stage in stages[:-1]:
            parts = parts.withColumns({f"\u0001{k}": c for k, c in stage.items()})
        return rows.join(parts.select(*self.keys, *[c.alias(k) for k, c in stages[-1].items()]), self.keys)

    def summed(self, rows: DataFrame, **sums: Column) -> DataFrame:
        """Add running sums by name."""
        known = rows.withColumns({f"\u0002{k}": c for k, c in sums.items()})
        known = self.carried(known, {k: F.sum(f"\u0002{k}") for k in sums}, {f"\u0003{k}": F.sum(of_part(k)).over(self.before()) for k in sums})
        totals = {k: plus(F.col(f"\u0003{k}"), F.sum(f"\u0002{k}").over(self.so_far())) for k in sums}
        return known.withColumns(totals).drop(*[f"\u0002{k}" for k in sums], *[f"\u0003{k}" for k in sums])

    def filled(self, rows: DataFrame, **values: Column) -> DataFrame:
        """Add the last known values so far by name."""
        known = rows.withColumns({f"\u0002{k}": c for k, c in values.items()})
        known = self.carried(known, {k: self.last(F.col(f"\u0002{k}")) for k in values}, {f"\u0003{k}": F.last(of_part(k), True).over(self.before()) for k in values})
        latest = {k: F.coalesce(F.last(f"\u0002{k}", True).over(self.so_far()), F.col(f"\u0003{k}")) for k in values}
        return known.withColumns(latest).drop(*[f"\u0002{k}" for k in values], *[f"\u0003{k}" for k in values])

    def previous(self, rows: DataFrame, name: str, value: Column) -> DataFrame:
        """Add the value of the row before, null at the first of a group; ``value`` mustn't be null."""
        known = rows.withColumn(f"\u0002{name}", value)
        known = self.carried(known, {name: F.max_by(f"\u0002{name}", self.order)}, {f"\u0003{name}": F.lag(of_part(name)).over(self.along())})
        earlier = F.coalesce(F.lag(f"\u0002{name}").over(self.inside()), F.col(f"\u0003{name}"))
        return known.withColumn(name, earlier).drop(f"\u0002{name}", f"\u0003{name}")

    def numbered(self, rows: DataFrame, name: str) -> DataFrame:
        """Number the rows of a group from 0."""
        known = self.carried(rows, {"n": F.count("*")}, {f"\u0003{name}": F.coalesce(F.sum(of_part("n")).over(self.before()), F.lit(0))})
        return known.withColumn(name, F.col(f"\u0003{name}") + F.row_number().over(self.inside()) - 1).drop(f"\u0003{name}")

    def told(self, rows: DataFrame, **values: Column) -> DataFrame:
        """Add the largest value of the group by name."""
        return self.carried(rows, {k: F.max(c) for k, c in values.items()}, {k: F.max(of_part(k)).over(self.whole()) for k in values})
