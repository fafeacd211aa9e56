"""Inputs of the registered queries, derived from the given tables by one SQL text that two engines evaluate alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_SEG = "CAST(floor((day(ts) - 1) / 10e0) AS INT)"
_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
_POINTS = f"""
SELECT user_id AS track_id, {_SEG} AS seg_no,
  CAST(row_number() OVER (PARTITION BY user_id, {_SEG} ORDER BY ts, event_id) AS INT) AS pt_no,
  TS_COLUMN AS ts, 14e0 + {_K} * 0.01e0 AS lon, 50e0 + ((event_id * 7919) % 1000) * 0.0005e0 AS lat,
  200e0 + value AS ele,
  CASE WHEN event_type = 'click' THEN value / 10e0 END AS speed,
  CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 60e0 + {_K} END AS heart_rate,
  CASE WHEN event_type IN ('click', 'view') THEN 70e0 + {_K} % 30 END AS cadence,
  CASE WHEN event_type IN ('view', 'purchase') THEN 100e0 + {_K} END AS power,
  10e0 + {_K} % 20 AS temperature, (20 + {_K} % 5) / 10e0 AS ratio
FROM {{events}}"""

#: SQL text by name; tables stand in braces.
SQL = {
    "trackpoints": _POINTS.replace("TS_COLUMN", "ts"),
    "timeless": _POINTS.replace("TS_COLUMN", "CASE WHEN event_type = 'error' AND user_id % 10 = 0 THEN NULL ELSE ts END"),
    "pois": """
SELECT c_custkey AS wpt_id, 14e0 + (c_custkey % 100) * 0.01e0 AS lon, 50e0 + ((c_custkey * 104729) % 1000) * 0.0005e0 AS lat,
  c_name AS name, c_mktsegment AS file, 200e0 + c_acctbal / 100e0 AS ele FROM {customer}""",
    "routepoints": """
SELECT l_orderkey AS route_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS pt_no,
  14e0 + (l_partkey % 100) * 0.01e0 AS lon, 50e0 + ((l_partkey * 7919) % 1000) * 0.0005e0 AS lat, 200e0 + l_partkey % 300 AS ele FROM {lineitem}""",
    "areas": """
SELECT area_id, name, CASE WHEN area_id % 20 = 7 THEN 179.5e0 ELSE 14e0 + (area_id % 5) * 0.2e0 END AS west, 50e0 + floor((area_id % 25) / 5e0) * 0.1e0 AS south,
  CASE WHEN area_id % 20 = 7 THEN -179.5e0 ELSE 14e0 + (area_id % 5) * 0.2e0 + 0.15e0 END AS east, 50e0 + floor((area_id % 25) / 5e0) * 0.1e0 + 0.08e0 AS north
FROM (SELECT s_suppkey AS area_id, s_name AS name FROM {supplier}) s""",
    "features": """
SELECT *, lon - 0.005e0 AS west, lon + 0.005e0 AS east, lat - 0.004e0 AS south, lat + 0.004e0 AS north FROM (
  SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 1 THEN 'node' ELSE 'way' END AS kind, p_size % 2 = 0 AS closed, p_size % 5 AS layer,
    p_brand AS brand, p_type AS type, CAST(p_size AS STRING) AS size, p_name AS title,
    CASE WHEN p_partkey % 50 IN (3, 28) THEN 179.7e0 WHEN p_partkey % 50 IN (4, 41) THEN -179.8e0 ELSE 14e0 + (p_partkey % 100) * 0.01e0 END AS lon,
    50e0 + ((p_partkey * 7919) % 1000) * 0.0005e0 AS lat
  FROM {part}) p""",
    "tiles": """
SELECT z, x, y, min(payload) AS payload FROM (SELECT l_linenumber AS z, l_partkey % CAST(pow(2, l_linenumber) AS BIGINT) AS x,
  l_suppkey % CAST(pow(2, l_linenumber) AS BIGINT) AS y, l_orderkey AS payload FROM {lineitem}) t GROUP BY z, x, y""",
    "requests": """
SELECT o_orderkey AS request, CAST(1 + o_orderkey % 9 AS INT) AS z, o_custkey % CAST(pow(2, 1 + o_orderkey % 9) AS BIGINT) AS x,
  (o_orderkey * 7) % CAST(pow(2, 1 + o_orderkey % 9) AS BIGINT) AS y FROM {orders}""",
    "dem": """
SELECT CAST(14 + floor(o_orderkey / 441e0) % 6 AS INT) AS tile_lon, CAST(50 + floor(floor(o_orderkey / 441e0) / 6) AS INT) AS tile_lat, 21 AS samples,
  CAST(floor((o_orderkey % 441) / 21e0) AS INT) AS row, CAST(o_orderkey % 21 AS INT) AS col,
  CASE WHEN o_custkey % 113 = 0 THEN NULL ELSE CAST(200 + (o_custkey * 31 + o_orderkey * 17) % 97 AS INT) END AS z FROM {orders}""",
    "messages": f"""
SELECT CAST(user_id AS STRING) AS file, event_id AS ord, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'record' WHEN event_type = 'signup' THEN 'event' ELSE 'lap' END AS kind,
  ts, CASE WHEN event_type = 'signup' THEN 30 + {_K} % 20 END AS front, CASE WHEN event_type = 'signup' THEN 11 + {_K} % 10 END AS rear,
  event_type = 'error' AND {_K} % 3 = 0 AS stop FROM {{events}}""",
    "positions": f"""
SELECT user_id AS device, event_id AS fix, ts, CASE WHEN {_K} = 50 THEN 200e0 ELSE 14e0 + {_K} * 0.01e0 END AS lon, 50e0 + ((event_id * 7919) % 1000) * 0.0005e0 AS lat,
  200e0 + value AS alt, CAST(({_K} * 7) % 360 AS DOUBLE) AS bearing, value / 10e0 AS speed FROM {{events}}""",
    "records": f"""
SELECT CAST(user_id AS STRING) AS file, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS n, event_id, event_type AS kind,
  {_K} AS k, CAST((event_id * 7919) % 1000 AS INT) AS m, date_trunc('second', ts) AS ts FROM {{events}}""",
}
_TABLE = re.compile(r"\{(\w+)\}")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = SQL[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(_TABLE.findall(text))}
    return spark.sql(text, **tables)


def plain(name: str) -> str:
    """The same text over tables that are registered by their names."""
    return _TABLE.sub(r"\1", SQL[name]).replace("AS STRING", "AS VARCHAR")
