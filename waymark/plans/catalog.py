"""Registered queries and the SQL that they are checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Register:
    """Decorator that keeps the queries of a module, and their SQL where there is one."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.queries[name] = f
            if sql is not None:
                self.oracle[name] = sql
            return f

        return keep


def _parts() -> list[Register]:
    from waymark.plans import live, logs, maps, motion, places, scalars

    return [m.register for m in (motion, places, maps, scalars, live, logs)]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance, time, pause and moving time of every track."""
    from waymark.plans import motion

    return motion.track_totals(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: f for part in _parts() for name, f in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _parts() for name, sql in part.oracle.items()}
