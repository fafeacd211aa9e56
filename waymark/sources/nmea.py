"""NMEA sentences: RMC and GGA fixes, WPL waypoints, ZDA dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import geo, texts
from waymark.operators.scan import Scan
from waymark.sources.common import Loaded, lines


def _seconds(text: Column) -> Column:
    """hhmmss[.sss] to seconds of the day."""
    ok = text.rlike(r"^\d{6}(\.\d*)?$")
    part = lambda at: F.substr(text, F.lit(at), F.lit(2)).try_cast("int")
    return F.when(ok, part(1) * 3600 + part(3) * 60 + F.substr(text, F.lit(5)).try_cast("double"))


def _date(text: Column) -> Column:
    """ddmmyy to yyyy-MM-dd; years from 80 are of the last century."""
    year = F.substr(text, F.lit(5), F.lit(2)).try_cast("int")
    full = F.when(year < 80, year + 2000).otherwise(year + 1900)
    return F.when(text.rlike(r"^\d{6}$"), F.format_string("%04d-%s-%s", full, F.substr(text, F.lit(3), F.lit(2)), F.substr(text, F.lit(1), F.lit(2))))


def sentences(lines: DataFrame, *keep: str) -> DataFrame:
    """(file, nth, columns to keep, kind, date, time_of_day, lon, lat, ele, name) of lines (file, nth, value); others and those with a wrong checksum field are left out."""
    body = F.regexp_extract("value", r"^\$..(RMC|GGA|WPL|ZDA),([^*]*)", 2)
    kind = F.regexp_extract("value", r"^\$..(RMC|GGA|WPL|ZDA),", 1)
    rows = lines.select("file", "nth", *keep, kind.alias("kind"), F.split(body, ",").alias("f")).where("kind <> ''")
    f = lambda i: F.get("f", F.lit(i))
    is_ = lambda k: F.col("kind") == k
    lat_at = F.when(is_("RMC"), 2).when(is_("GGA"), 1).when(is_("WPL"), 0)
    lat = texts.nmea_angle(F.get("f", lat_at), F.get("f", lat_at + 1))
    lon = texts.nmea_angle(F.get("f", lat_at + 2), F.get("f", lat_at + 3))
    usable = F.when(is_("RMC"), f(1) == "A").when(is_("GGA"), F.coalesce(f(5) != "0", F.lit(False))).otherwise(F.lit(True))
    date = F.when(is_("RMC"), _date(f(8))).when(is_("ZDA"), F.when(f(3).rlike(r"^\d{4}$"), F.format_string("%s-%s-%s", f(3), f(2), f(1))))
    ele = F.when(is_("GGA"), f(8).try_cast("double") - F.coalesce(f(10).try_cast("double"), F.lit(0.0)))
    return rows.select(
        "file", "nth", *keep, "kind", date.alias("date"), F.when(~is_("WPL"), _seconds(f(0))).alias("time_of_day"), F.when(usable, lon).alias("lon"), F.when(usable, lat).alias("lat"), ele.alias("ele"), F.when(is_("WPL"), f(4)).alias("name")
    )


def read_nmea(spark: SparkSession, path: str, glob: str = "*.nmea") -> Loaded:
    """One track a file. The date of RMC and ZDA is carried to the fixes; the time going back means the next day.

    From the first GGA on, places of RMC don't count.
    """
    s = sentences(lines(spark, path, glob).select("file", "split", F.col("line_no").alias("nth"), F.col("line").alias("value")), "split")
    scan = Scan(("file",), "split", "nth")
    s = scan.filled(s, day=F.col("date"))
    # a new date resets the count of midnights since it was told
    s = scan.summed(s, gga=(F.col("kind") == "GGA").cast("int"), told=F.col("date").isNotNull().cast("int"))
    fixes = s.where(geo.valid(F.col("lon"), F.col("lat")) & ((F.col("kind") == "GGA") | ((F.col("kind") == "RMC") & (F.col("gga") == 0))))
    fixes = scan.previous(fixes, "b", F.struct("time_of_day", "day", "told"))
    goes_back = (F.col("kind") == "GGA") & (F.col("time_of_day") < F.col("b.time_of_day")) & (F.col("day") == F.col("b.day"))
    fixes = scan.summed(fixes.withColumn("back", F.coalesce(goes_back, F.lit(False)).cast("int")), backs=F.col("back"))
    opens = F.col("b").isNull() | (F.col("b.told") != F.col("told"))
    fixes = scan.filled(fixes, base=F.when(opens, F.col("backs") - F.col("back"))).withColumn("days", F.col("backs") - F.col("base"))
    micros = (F.col("time_of_day") * 1e6).cast("long") + F.unix_micros(F.date_add(F.col("day").cast("date"), F.col("days").cast("int")).cast("timestamp"))
    points = fixes.select("file", F.lit(0).alias("track_no"), F.lit(0).alias("seg_no"), "nth", "split", "lon", "lat", "ele", F.when(F.col("day").isNotNull(), F.timestamp_micros(micros)).alias("ts"))
    points = scan.numbered(points, "pt_no")
    way = s.where((F.col("kind") == "WPL") & geo.valid(F.col("lon"), F.col("lat"))).select("file", F.col("nth").alias("wpt_no"), "lon", "lat", "name")
    return Loaded(trackpoints=points, waypoints=way).completed(spark)
