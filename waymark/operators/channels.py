"""Sensor series of tracks: choice, numbering, smoothing and re-zeroing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Smoothing windows in points by channel; channels not named aren't smoothed.
WINDOWS = {"elevation": 3, "speed": 5, "reported_speed": 5, "heart_rate": 3, "cadence": 3, "power": 3}
#: Channels that are 0 at stops, before and after smoothing.
ZERO_AT_STOPS = frozenset({"speed", "reported_speed", "cadence", "power"})
#: Columns of enriched points by channel.
COLUMNS = {
    "elevation": "ele",
    "speed": "v",
    "reported_speed": "speed",
    "heart_rate": "heart_rate",
    "temperature": "temperature",
    "ratio": "ratio",
    "cadence": "cadence",
    "power": "power",
}


def _series():
    return Window.partitionBy("track_id", "seg_no", "channel")


def unpivoted(enriched: DataFrame, channels: list[str]) -> DataFrame:
    """One row a point and channel with a value; stops count as 0 in channels that rest there.

    Outliers are left out unless they are stops of such a channel, which they
    can't be.
    """
    values = []
    for name in channels:
        y = F.col(COLUMNS[name]).cast("double")
        if name in ZERO_AT_STOPS:
            y = F.when(F.col("is_stop") & y.isNotNull(), 0.0).otherwise(y)
        values.append(F.struct(F.lit(name).alias("channel"), y.alias("y")))
    rows = enriched.where(~F.col("is_outlier")).select(
        "track_id", "seg_no", "pt_no", F.col("dist").alias("s"), "t", "is_stop", F.explode(F.array(*values)).alias("c")
    )
    return rows.select("track_id", "seg_no", "pt_no", "s", "t", "is_stop", "c.channel", "c.y").where("y is not null")


def smoothed(series: DataFrame, windows: dict[str, int] | None = None) -> DataFrame:
    """Add g_no, n and y smoothed by a centred mean; edges hold the mean of the first or last full window.

    Only odd windows are allowed. Series shorter than their window, or with a
    window under 2, stay as they are.
    """
    windows = WINDOWS if windows is None else windows
    if any(w % 2 == 0 for w in windows.values()):
        raise ValueError("smoothing windows must be odd")
    order = _series().orderBy("pt_no")
    out = series.withColumns({"g_no": F.row_number().over(order) - 1, "n": F.count("*").over(_series())}).withColumn("raw", F.col("y"))
    result: Column = F.col("raw")
    for width in sorted({w for w in windows.values() if w > 1}):
        half = width // 2
        out = out.withColumn(f"mean{width}", F.avg("raw").over(order.rowsBetween(-half, half)))
        first = F.max(F.when(F.col("g_no") == half, F.col(f"mean{width}"))).over(_series())
        last = F.max(F.when(F.col("g_no") == F.col("n") - 1 - half, F.col(f"mean{width}"))).over(_series())
        held = F.when(F.col("g_no") < half, first).when(F.col("g_no") > F.col("n") - 1 - half, last).otherwise(F.col(f"mean{width}"))
        names = [c for c, w in windows.items() if w == width]
        result = F.when(F.col("channel").isin(names) & (F.col("n") >= width), held).otherwise(result)
    return out.withColumn("y", result).drop(*[f"mean{w}" for w in windows.values()])


def graph(enriched: DataFrame, channels: list[str] | None = None, windows: dict[str, int] | None = None) -> DataFrame:
    """(track_id, channel, seg_no, g_no, s, t, y): the series of each channel with two points or more."""
    channels = list(COLUMNS) if channels is None else channels
    out = smoothed(unpivoted(enriched, channels), windows)
    rests = F.col("channel").isin(sorted(ZERO_AT_STOPS)) & F.col("is_stop")
    return out.where("n >= 2").select(
        "track_id", "channel", "seg_no", F.col("g_no").cast("int").alias("g_no"), "s", "t", F.when(rests, 0.0).otherwise(F.col("y")).alias("y")
    )


def primary_secondary(preferred: DataFrame, other: DataFrame, with_secondary: bool = True) -> DataFrame:
    """Two graphs of one quantity: the preferred is primary unless it is empty for a track; role tells which.

    The other series is secondary on request, and never where it had to become
    the primary one.
    """
    has = preferred.select("track_id").distinct().withColumn("has", F.lit(True))
    rest = other.join(has, "track_id", "left")
    role = F.when(F.col("has"), "secondary").otherwise("primary")
    rest = rest.withColumn("role", role).drop("has")
    if not with_secondary:
        rest = rest.where("role = 'primary'")
    return preferred.withColumn("role", F.lit("primary")).unionByName(rest)


def elevation_of(own: Column, terrain: Column, prefer_terrain: bool = False) -> Column:
    """Elevation of a single place: the preferred of both, else the other."""
    return F.coalesce(terrain, own) if prefer_terrain else F.coalesce(own, terrain)
