"""Readers of XML logs: GPX, TCX, KML, SLF, SML and LOC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.sources.common import Loaded
from waymark.sources.pull import broken, elements, of_tag

_SENSORS = "hr:double,heartrate:double,temp:double,atemp:double,wtemp:double,cad:double,cadence:double,power:double,PowerInWatts:double,speed:double"
_POINT = (
    f"_lat:double,_lon:double,ele:double,geoidheight:double,time:string,name:string,cmt:string,desc:string,sym:string,"
    f"link:array<struct<_href:string,text:string>>,extensions:struct<TrackPointExtension:struct<{_SENSORS}>,RoutePointExtension:struct<rpt:array<struct<_lat:double,_lon:double>>>,address:string,phone:string,{_SENSORS}>"
)


def _time(text: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(F.concat(text, F.lit("Z"))))


def _sensor(p: Column, *names: str) -> Column:
    """First of some aliases, in the point's own extension and in the plain one."""
    return F.coalesce(*[x for n in names for x in (p["extensions"]["TrackPointExtension"][n], p["extensions"][n])])


def _structs(df: DataFrame, *places: Column) -> DataFrame:
    """File, places and the element itself as p."""
    own = [c for c in df.columns if c not in ("file", "row_no", "at")]
    return df.select("file", *places, F.struct(*own).alias("p"))


def _gpx_point(p: str) -> list[Column]:
    c = F.col(p)
    return [
        c["_lon"].alias("lon"),
        c["_lat"].alias("lat"),
        (c["ele"] - F.coalesce(c["geoidheight"], F.lit(0.0))).alias("ele"),
        _time(c["time"]).alias("ts"),
    ]


def read_gpx(spark: SparkSession, path: str, glob: str = "*.gpx") -> Loaded:
    """Tracks, routes (with their shaping points as one more track), waypoints and areas.

    Points out of range are errors of their file and left out.
    """
    found = elements(spark, path, glob, {"trkpt": ("trk", "trkseg"), "rtept": ("rte",), "wpt": (), "area": ()})
    place = lambda k: F.col("at")[k]
    pts = _structs(of_tag(found, "trkpt", _columns(_POINT)), place(0).alias("track_no"), place(1).alias("seg_no"), place(2).alias("pt_no"))
    p = F.col("p")
    points = pts.select(
        "file", "track_no", "seg_no", "pt_no", *_gpx_point("p"),
        _sensor(p, "hr", "heartrate").alias("heart_rate"),
        _sensor(p, "temp", "atemp", "wtemp").alias("temperature"),
        _sensor(p, "cad", "cadence").alias("cadence"),
        _sensor(p, "power", "PowerInWatts").alias("power"),
        _sensor(p, "speed").alias("speed"),
    )
    rtept = _structs(of_tag(found, "rtept", _columns(_POINT)), place(0).alias("route_no"), place(1).alias("pt_no"))
    route = rtept.select("file", "route_no", "pt_no", *_gpx_point("p"), F.col("p.name").alias("name"))
    # each route point is followed by the points that shape the way to the next one
    here = F.array(F.struct(F.col("p._lat").alias("_lat"), F.col("p._lon").alias("_lon")))
    more = F.coalesce(F.col("p.extensions.RoutePointExtension.rpt"), F.array().cast("array<struct<_lat:double,_lon:double>>"))
    shaped = rtept.withColumn("has", F.max(F.size(more)).over(Window.partitionBy("file", "route_no"))).where("has > 0")
    shaped = shaped.select("file", "route_no", F.col("pt_no").alias("at"), F.posexplode(F.concat(here, more)).alias("k", "q"))
    order = Window.partitionBy("file", "route_no").orderBy("at", "k")
    shaping = shaped.select(
        "file", (F.col("route_no") + 1_000_000).alias("track_no"), F.lit(0).alias("seg_no"), (F.row_number().over(order) - 1).alias("pt_no"), F.col("q._lon").alias("lon"), F.col("q._lat").alias("lat")
    )
    points = points.unionByName(shaping, allowMissingColumns=True)
    wpt = of_tag(found, "wpt", _columns(_POINT))
    way = wpt.select(
        "file", F.col("row_no").alias("wpt_no"), F.col("_lon").alias("lon"), F.col("_lat").alias("lat"), (F.col("ele") - F.coalesce("geoidheight", F.lit(0.0))).alias("ele"), _time(F.col("time")).alias("ts"),
        "name", F.col("desc").alias("description"), F.col("cmt").alias("comment"), F.col("sym").alias("symbol"), F.col("extensions.address").alias("address"), F.col("extensions.phone").alias("phone"),
        F.transform("link", lambda x: F.struct(x["_href"].alias("url"), x["text"].alias("text"))).alias("links"),
    )
    area = of_tag(found, "area", "name string, desc string, polygon array<struct<linearRing:array<struct<point:array<struct<_lat:double,_lon:double>>>>>>")
    areas = area.select("file", F.col("row_no").alias("area_no"), "name", F.col("desc").alias("description"), _rings(F.col("polygon")).alias("rings"))
    errors, out = broken(found), {}
    for name, df in (("trackpoints", points), ("routepoints", route), ("waypoints", way)):
        good = geo.valid(F.col("lon"), F.col("lat"))
        bad = df.where(~good).select("file", F.lit(None).cast("int").alias("line"), F.lit(f"invalid coordinates in {name}").alias("msg"))
        errors = errors.unionByName(bad)
        out[name] = df.where(good)
    return Loaded(**out, areas=with_box(areas), errors=errors).completed(spark)


def _columns(fields: str) -> str:
    """Fields of a struct as columns: a blank for the colon after each outermost name."""
    out, depth, named = [], 0, False
    for c in fields:
        depth += (c == "<") - (c == ">")
        if depth == 0 and c == ",":
            named = False
        if depth == 0 and c == ":" and not named:
            c, named = " ", True
        out.append(c)
    return "".join(out)


def _rings(polygons: Column) -> Column:
    return F.transform(
        polygons, lambda p: F.transform(p["linearRing"], lambda ring: F.transform(ring["point"], lambda q: F.struct(q["_lon"].alias("lon"), q["_lat"].alias("lat"))))
    )


def with_box(areas: DataFrame) -> DataFrame:
    """Areas whose outer rings have three points or more, with their bounding box."""
    flat = F.flatten(F.flatten("rings"))
    side = lambda f, c: f(F.transform(flat, lambda q: q[c]))
    valid = F.forall("rings", lambda p: F.size(p[0]) >= 3) & (F.size("rings") > 0)
    return areas.where(valid).withColumns(
        {"west": side(F.array_min, "lon"), "south": side(F.array_min, "lat"), "east": side(F.array_max, "lon"), "north": side(F.array_max, "lat")}
    )


def read_tcx(spark: SparkSession, path: str, glob: str = "*.tcx") -> Loaded:
    """Activities: one segment each, laps merged. Courses: a segment for each track, course points as waypoints. Points without a place are dropped."""
    point = "Time:string,Position:struct<LatitudeDegrees:double,LongitudeDegrees:double>,AltitudeMeters:double,HeartRateBpm:struct<Value:double>,Cadence:double,Extensions:struct<TPX:struct<Speed:double,Watts:double,RunCadence:double>>"
    track = f"array<struct<Trackpoint:array<struct<{point}>>>>"
    found = elements(spark, path, glob, {"Activity": (), "Course": ()})
    act = of_tag(found, "Activity", f"Id string, Lap array<struct<Track:{track}>>")
    merged = F.flatten(F.transform(F.flatten("Lap.Track"), lambda t: t["Trackpoint"]))
    from_laps = act.select("file", F.col("row_no").alias("track_no"), F.lit(0).alias("seg_no"), F.posexplode(merged).alias("pt_no", "p"))
    crs = of_tag(found, "Course", f"Name string, Track {track}, CoursePoint array<struct<Name:string,Time:string,Position:struct<LatitudeDegrees:double,LongitudeDegrees:double>,Notes:string>>")
    segs = crs.select("file", (F.col("row_no") + 1_000_000).alias("track_no"), F.posexplode("Track").alias("seg_no", "t"))
    from_courses = segs.select("file", "track_no", "seg_no", F.posexplode("t.Trackpoint").alias("pt_no", "p"))
    p = F.col("p")
    points = from_laps.unionByName(from_courses).select(
        "file", "track_no", "seg_no", "pt_no", p["Position"]["LongitudeDegrees"].alias("lon"), p["Position"]["LatitudeDegrees"].alias("lat"), p["AltitudeMeters"].alias("ele"), _time(p["Time"]).alias("ts"),
        p["HeartRateBpm"]["Value"].alias("heart_rate"), F.coalesce(p["Cadence"], p["Extensions"]["TPX"]["RunCadence"]).alias("cadence"), p["Extensions"]["TPX"]["Speed"].alias("speed"), p["Extensions"]["TPX"]["Watts"].alias("power"),
    )
    named = crs.select("file", F.col("row_no").alias("c"), F.posexplode("CoursePoint").alias("k", "w"))
    way = named.select("file", (F.col("c") * 10_000 + F.col("k")).alias("wpt_no"), F.col("w.Position.LongitudeDegrees").alias("lon"), F.col("w.Position.LatitudeDegrees").alias("lat"), F.col("w.Name").alias("name"), F.col("w.Notes").alias("description"), _time(F.col("w.Time")).alias("ts"))
    good = geo.valid(F.col("lon"), F.col("lat"))
    return Loaded(trackpoints=points.where(good), waypoints=way.where(good), errors=broken(found)).completed(spark)


_KML_ARRAYS = ("heartrate", "cadence", "speed", "temperature", "power")


def _tuples(text: Column) -> Column:
    """"lon,lat[,ele] ..." to an array of structs."""
    parts = F.filter(F.split(F.trim(text), r"\s+"), lambda s: s != "")

    def one(s: Column) -> Column:
        v = F.split(s, ",")
        return F.struct(v[0].try_cast("double").alias("lon"), F.get(v, F.lit(1)).try_cast("double").alias("lat"), F.get(v, F.lit(2)).try_cast("double").alias("ele"))

    return F.transform(parts, one)


def read_kml(spark: SparkSession, path: str, glob: str = "*.kml") -> Loaded:
    """Placemarks at any depth: points, lines, rings, polygons, timed tracks; photo overlays as waypoints with an image.

    A timed track whose times and places differ in number is an error; sensor
    arrays go with the places by index.
    """
    gx = "struct<when:array<string>,coord:array<string>,ExtendedData:struct<SchemaData:struct<SimpleArrayData:array<struct<_name:string,value:array<double>>>>>>"
    line = "struct<coordinates:string>"
    ring = "struct<LinearRing:struct<coordinates:string>>"
    poly = f"struct<outerBoundaryIs:{ring},innerBoundaryIs:array<{ring}>>"
    geom = f"Point:{line},LineString:array<{line}>,LinearRing:array<{line}>,Polygon:array<{poly}>"
    found = elements(spark, path, glob, {"Placemark": (), "PhotoOverlay": ()})
    pm = of_tag(
        found, "Placemark",
        f"name string, description string, address string, phoneNumber string, styleUrl string, TimeStamp struct<when:string>, Point {line}, LineString {line}, LinearRing {line}, Polygon {poly}, Track {gx}, MultiTrack struct<Track:array<{gx}>>, MultiGeometry struct<{geom}>",
    )
    way = pm.where("Point is not null").select("file", F.col("row_no").alias("wpt_no"), "name", "description", "address", F.col("phoneNumber").alias("phone"), _time(F.col("TimeStamp.when")).alias("ts"), _tuples(F.col("Point.coordinates"))[0].alias("c"))
    photo = of_tag(found, "PhotoOverlay", f"name string, description string, Icon struct<href:string>, Point {line}").select(
        "file", (F.col("row_no") + 1_000_000).alias("wpt_no"), "name", "description", F.array("Icon.href").alias("images"), _tuples(F.col("Point.coordinates"))[0].alias("c")
    )
    way = way.unionByName(photo, allowMissingColumns=True).select("*", "c.lon", "c.lat", "c.ele").drop("c")
    lines = F.concat(
        F.when(F.col("LineString").isNotNull(), F.array("LineString.coordinates")).otherwise(F.array().cast("array<string>")),
        F.when(F.col("LinearRing").isNotNull(), F.array("LinearRing.coordinates")).otherwise(F.array().cast("array<string>")),
        F.coalesce(F.col("MultiGeometry.LineString.coordinates"), F.array().cast("array<string>")),
        F.coalesce(F.col("MultiGeometry.LinearRing.coordinates"), F.array().cast("array<string>")),
    )
    plain = pm.select("file", F.col("row_no").alias("track_no"), F.posexplode(lines).alias("seg_no", "text"))
    plain = plain.select("file", "track_no", "seg_no", F.posexplode(_tuples(F.col("text"))).alias("pt_no", "c")).select("file", "track_no", "seg_no", "pt_no", "c.lon", "c.lat", "c.ele")
    timed = F.concat(F.when(F.col("Track").isNotNull(), F.array("Track")).otherwise(F.array().cast(f"array<{gx}>")), F.coalesce(F.col("MultiTrack.Track"), F.array().cast(f"array<{gx}>")))
    gt = pm.select("file", F.col("row_no").alias("track_no"), F.posexplode(timed).alias("seg_no", "g"))
    fits = F.size("g.when") == F.size("g.coord")
    bad = gt.where(~F.coalesce(fits, F.lit(False))).select("file", F.lit(None).cast("int").alias("line"), F.lit("times and places differ in number").alias("msg"))
    zipped = gt.where(fits).withColumn("data", F.map_from_entries(F.transform(F.coalesce(F.col("g.ExtendedData.SchemaData.SimpleArrayData"), F.array().cast("array<struct<_name:string,value:array<double>>>")), lambda a: F.struct(a["_name"], a["value"]))))
    pts = zipped.select("file", "track_no", "seg_no", "data", F.posexplode(F.arrays_zip(F.col("g.when").alias("at"), F.col("g.coord").alias("place")).cast("array<struct<at:string,place:string>>")).alias("pt_no", "p"))
    place = F.split(F.trim("p.place"), r"\s+")
    sensor = {n: F.get(F.col("data")[n], F.col("pt_no")) for n in _KML_ARRAYS}
    with_time = pts.select(
        "file", "track_no", "seg_no", "pt_no", _time(F.col("p.at")).alias("ts"), place[0].try_cast("double").alias("lon"), F.get(place, F.lit(1)).try_cast("double").alias("lat"), F.get(place, F.lit(2)).try_cast("double").alias("ele"),
        *[v.alias("heart_rate" if n == "heartrate" else n) for n, v in sensor.items()],
    )
    points = plain.unionByName(with_time, allowMissingColumns=True).where(geo.valid(F.col("lon"), F.col("lat")))
    to_ring = lambda text: F.transform(_tuples(text), lambda q: F.struct(q["lon"].alias("lon"), q["lat"].alias("lat")))
    to_rings = lambda p: F.concat(
        F.array(to_ring(p["outerBoundaryIs"]["LinearRing"]["coordinates"])),
        F.transform(F.coalesce(p["innerBoundaryIs"], F.array().cast(f"array<{ring}>")), lambda r: to_ring(r["LinearRing"]["coordinates"])),
    )
    polys = F.concat(F.when(F.col("Polygon").isNotNull(), F.array("Polygon")).otherwise(F.array().cast(f"array<{poly}>")), F.coalesce(F.col("MultiGeometry.Polygon"), F.array().cast(f"array<{poly}>")))
    areas = pm.where(F.size(polys) > 0).select("file", F.col("row_no").alias("area_no"), "name", "description", F.transform(polys, to_rings).alias("rings"))
    return Loaded(trackpoints=points, waypoints=way.where(geo.valid(F.col("lon"), F.col("lat"))), areas=with_box(areas), errors=broken(found).unionByName(bad)).completed(spark)


def _long_date(text: Column) -> Column:
    """A date like Mon Jan 1 10:00:00 GMT+0000 2024."""
    parts = F.regexp_replace(text, r"^\w+ (\w+) (\d+) ([\d:]+) GMT([-+]\d{4}) (\d{4})$", "$5 $1 $2 $3 $4")
    return F.try_to_timestamp(parts, F.lit("yyyy MMM d HH:mm:ss xx"))


def read_slf(spark: SparkSession, path: str, glob: str = "*.slf") -> Loaded:
    """Entries of an activity: altitude in mm, time in hundredths of seconds since the start; entries at 0, 0 are dropped."""
    found = elements(spark, path, glob, {"Activity": ()})
    act = of_tag(found, "Activity", "GeneralInformation struct<startDate:string>, Entries struct<Entry:array<struct<_altitude:double,_cadence:double,_heartrate:double,_power:double,_speed:double,_latitude:double,_longitude:double,_trainingTimeAbsolute:double>>>")
    pts = act.select("file", F.col("row_no").alias("track_no"), F.lit(0).alias("seg_no"), _long_date(F.col("GeneralInformation.startDate")).alias("start"), F.posexplode("Entries.Entry").alias("pt_no", "e"))
    ms = F.unix_millis(F.coalesce("start", F.lit("1970-01-01").cast("timestamp"))) + (F.col("e._trainingTimeAbsolute") * 10).cast("long")
    points = pts.select(
        "file", "track_no", "seg_no", "pt_no", F.col("e._longitude").alias("lon"), F.col("e._latitude").alias("lat"), (F.col("e._altitude") / 1000.0).alias("ele"), F.col("e._cadence").alias("cadence"), F.col("e._heartrate").alias("heart_rate"),
        F.col("e._power").alias("power"), F.col("e._speed").alias("speed"), F.when(F.col("start").isNotNull(), F.timestamp_millis(ms)).alias("ts"),
    )
    return Loaded(trackpoints=points.where(geo.valid(F.col("lon"), F.col("lat")) & ~((F.col("lon") == 0) & (F.col("lat") == 0))), errors=broken(found)).completed(spark)


def read_sml(spark: SparkSession, path: str, glob: str = "*.sml") -> Loaded:
    """Places in radians; each takes the first sensor sample that isn't earlier. Kelvin to Celsius, hertz to beats a minute."""
    from waymark.operators.lookup import next_sample

    found = elements(spark, path, glob, {"Sample": ()})
    s = of_tag(found, "Sample", "SampleType string, UTC string, Latitude double, Longitude double, GPSAltitude double, HR double, Temperature double, Cadence double, Speed double, Power double")
    s = s.withColumns({"ts": _time(F.col("UTC")), "lon": F.degrees("Longitude"), "lat": F.degrees("Latitude")})
    is_place = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    places = s.where(is_place).select("file", F.lit(0).alias("track_no"), F.lit(0).alias("seg_no"), F.col("row_no").alias("pt_no"), "ts", "lon", "lat", F.col("GPSAltitude").alias("ele"))
    sensors = s.where(~is_place).select("file", "ts", F.col("row_no").alias("nth"), (F.col("HR") * 60.0).alias("heart_rate"), (F.col("Temperature") - 273.15).alias("temperature"), (F.col("Cadence") * 60.0).alias("cadence"), F.col("Speed").alias("speed"), F.col("Power").alias("power"))
    points = next_sample(places, sensors, ["file"], "ts", ["heart_rate", "temperature", "cadence", "speed", "power"])
    return Loaded(trackpoints=points.where(geo.valid(F.col("lon"), F.col("lat"))), errors=broken(found)).completed(spark)


def read_loc(spark: SparkSession, path: str, glob: str = "*.loc") -> Loaded:
    found = elements(spark, path, glob, {"waypoint": ()})
    w = of_tag(found, "waypoint", "name struct<_VALUE:string,_id:string>, coord struct<_lat:double,_lon:double>, link struct<_VALUE:string,_text:string>")
    way = w.select("file", F.col("row_no").alias("wpt_no"), F.col("coord._lon").alias("lon"), F.col("coord._lat").alias("lat"), F.col("name._id").alias("name"), F.trim("name._VALUE").alias("description"), F.array(F.struct(F.trim("link._VALUE").alias("url"), F.col("link._text").alias("text"))).alias("links"))
    good = geo.valid(F.col("lon"), F.col("lat"))
    bad = way.where(~good).select("file", F.lit(None).cast("int").alias("line"), F.lit("invalid coordinates").alias("msg"))
    return Loaded(waypoints=way.where(good), errors=broken(found).unionByName(bad)).completed(spark)
