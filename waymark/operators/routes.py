"""Routes: ordered waypoints without times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo


def _order():
    return Window.partitionBy("route_id").orderBy("pt_no")


def with_distance(routepoints: DataFrame) -> DataFrame:
    """Add dist, the cumulative distance."""
    before = F.lag(F.struct("lon", "lat")).over(_order())
    step = F.coalesce(geo.distance(before["lon"], before["lat"], F.col("lon"), F.col("lat")), F.lit(0.0))
    return routepoints.withColumn("ds", step).withColumn("dist", F.sum("ds").over(_order())).drop("ds")


def totals(routepoints: DataFrame) -> DataFrame:
    """(route_id, dist, points) of routes with two points or more."""
    return with_distance(routepoints).groupBy("route_id").agg(F.max("dist").alias("dist"), F.count("*").alias("points")).where("points >= 2")


def elevation_graph(routepoints: DataFrame) -> DataFrame:
    """(route_id, g_no, s, y): elevation over distance at points that have one; neither time nor smoothing."""
    rows = with_distance(routepoints).where("ele is not null")
    n = F.count("*").over(Window.partitionBy("route_id"))
    return rows.withColumns({"g_no": F.row_number().over(_order()) - 1, "n": n}).where("n >= 2").select("route_id", "g_no", F.col("dist").alias("s"), F.col("ele").alias("y"))
