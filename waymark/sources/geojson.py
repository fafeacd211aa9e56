"""GeoJSON: points, lines and polygons alone, in features and in collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import geo, projection
from waymark.operators.lineage import checkpointed
from waymark.sources.common import Loaded
from waymark.sources.xml import with_box

_CRS = "crs:struct<properties:struct<name:string>>"
_GEOMETRY = f"type:string,coordinates:string,{_CRS}"
_PROPERTIES = "struct<name:string,title:string,description:string,stroke:string,fill:string,`marker-color`:string,coordinateProperties:struct<times:string,heart:string>>"
_OBJECT = f"type string, coordinates string, crs struct<properties:struct<name:string>>, geometries array<struct<{_GEOMETRY}>>, geometry struct<{_GEOMETRY},geometries:array<struct<{_GEOMETRY}>>>, properties {_PROPERTIES}, features array<struct<type:string,geometry:struct<{_GEOMETRY},geometries:array<struct<{_GEOMETRY}>>>,properties:{_PROPERTIES},{_CRS}>>"


def _is_web_mercator(crs: Column) -> Column:
    return F.coalesce(crs.rlike(r"(?:3857|900913)$"), F.lit(False))


def _place(v: Column, crs: Column) -> Column:
    """An ordinate array to lon, lat, ele; Web Mercator metres become degrees."""
    x, y = F.get(v, F.lit(0)), F.get(v, F.lit(1))
    lon, lat = projection.from_web_mercator(x, y)
    web = _is_web_mercator(crs)
    return F.struct(F.when(web, lon).otherwise(x).alias("lon"), F.when(web, lat).otherwise(y).alias("lat"), F.get(v, F.lit(2)).alias("ele"))


def geometries(spark: SparkSession, path: str, glob: str = "*.geojson") -> DataFrame:
    """(file, nth, type, coordinates as JSON text, crs, properties) of each simple geometry, the nearest crs above it counting."""
    df = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).schema(_OBJECT).json(path).select("*", F.col("_metadata.file_path").alias("file"))
    none = F.lit(None)
    feature = F.struct("type", "geometry", "properties", F.col("crs"))
    kinds = F.when(F.col("type") == "FeatureCollection", F.col("features")).when(F.col("type") == "Feature", F.array(feature)).otherwise(
        F.array(
            F.struct(
                F.lit("Feature").alias("type"),
                F.struct("type", "coordinates", "crs", "geometries").alias("geometry"),
                none.cast(_PROPERTIES).alias("properties"),
                F.col("crs"),
            )
        )
    )
    each = df.select("file", F.col("crs.properties.name").alias("top"), F.posexplode(kinds).alias("feature_no", "f"))
    inner = F.when(F.col("f.geometry.type") == "GeometryCollection", F.col("f.geometry.geometries")).otherwise(F.array(F.struct("f.geometry.type", "f.geometry.coordinates", "f.geometry.crs")))
    flat = each.select("file", "feature_no", "top", F.col("f.geometry.crs.properties.name").alias("mid"), F.col("f.crs.properties.name").alias("own"), F.col("f.properties").alias("properties"), F.posexplode(inner).alias("part_no", "g"))
    return flat.select(
        "file", (F.col("feature_no") * 1000 + F.col("part_no")).alias("nth"), F.col("g.type").alias("type"), F.col("g.coordinates").alias("coordinates"), F.coalesce("g.crs.properties.name", "mid", "own", "top").alias("crs"), "properties"
    )


def read_geojson(spark: SparkSession, path: str, glob: str = "*.geojson") -> Loaded:
    """Points to waypoints, lines to tracks (a segment for each line), polygons to areas; times and heart rates go with the points of a line where they are as many."""
    # kept, as each kind of geometry would read and parse all files again
    g = checkpointed(geometries(spark, path, glob))
    crs = F.col("crs")
    name = F.coalesce(F.col("properties.title"), F.col("properties.name"))
    lists = {d: f"{'array<' * d}double{'>' * d}" for d in (1, 2, 3, 4)}

    def of(kind: str, depth: int, wrap: int = 0) -> DataFrame:
        c = F.from_json("coordinates", lists[depth])
        for _ in range(wrap):
            c = F.array(c)
        return g.where(F.col("type") == kind).withColumn("c", c)

    singles = of("Point", 1, 1).unionByName(of("MultiPoint", 2))
    way = singles.select("file", "nth", name.alias("name"), F.col("properties.description").alias("description"), "crs", F.posexplode("c").alias("k", "v"))
    way = way.select("file", (F.col("nth") * 1000 + F.col("k")).alias("wpt_no"), "name", "description", _place(F.col("v"), crs).alias("p")).select("*", "p.*").drop("p")
    lines = of("LineString", 2, 1).unionByName(of("MultiLineString", 3))
    extra = lines.select("file", F.col("nth").alias("track_no"), "crs", F.from_json("properties.coordinateProperties.times", "array<string>").alias("times"), F.from_json("properties.coordinateProperties.heart", "array<double>").alias("heart"), F.posexplode("c").alias("seg_no", "line"))
    fits = lambda a: F.size(a) == F.size("line")
    pts = extra.select("file", "track_no", "seg_no", "crs", F.when(fits("times"), F.col("times")).alias("times"), F.when(fits("heart"), F.col("heart")).alias("heart"), F.posexplode("line").alias("pt_no", "v"))
    at = F.get("times", F.col("pt_no"))
    ts = F.when(at.rlike(r"^\d+$"), F.timestamp_millis(at.try_cast("long"))).otherwise(F.try_to_timestamp(at))
    points = pts.select("file", "track_no", "seg_no", "pt_no", ts.alias("ts"), F.get("heart", F.col("pt_no")).alias("heart_rate"), _place(F.col("v"), crs).alias("p")).select("*", "p.*").drop("p")
    polys = of("Polygon", 3, 1).unionByName(of("MultiPolygon", 4))
    rings = F.transform("c", lambda poly: F.transform(poly, lambda ring: F.transform(ring, lambda v: F.struct(_place(v, crs)["lon"].alias("lon"), _place(v, crs)["lat"].alias("lat")))))
    areas = polys.select("file", F.col("nth").alias("area_no"), name.alias("name"), F.col("properties.description").alias("description"), rings.alias("rings"))
    good = geo.valid(F.col("lon"), F.col("lat"))
    bad = points.where(~good).select("file").unionByName(way.where(~good).select("file")).distinct().select("file", F.lit(None).cast("int").alias("line"), F.lit("invalid coordinates").alias("msg"))
    return Loaded(trackpoints=points.where(good), waypoints=way.where(good), areas=with_box(areas), errors=bad).completed(spark)
