"""Readers of line-based logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import geo, projection, texts
from waymark.operators.scan import Scan
from waymark.sources.common import IN_FILE, Loaded, first_error, in_file, lines, lines_of, number, numbered, split_valid


def _part(parts: str, i: int) -> Column:
    return F.trim(F.get(parts, F.lit(i)))


def _ranked(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    return Scan(tuple(keys), "split", "line_no").numbered(df, name)


def read_csv(spark: SparkSession, path: str, glob: str = "*.csv") -> Loaded:
    """Waypoints lon, lat, name[, description]; a file with a bad row is an error."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("quote", '"').option("escape", '"').option("multiLine", True).option("mode", "PERMISSIVE").schema("lon string, lat string, name string, description string").csv(path)
    df = df.select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("nth"))
    df = df.withColumn("line_no", F.row_number().over(Window.partitionBy("file").orderBy("nth"))).withColumns({"lon": number(F.col("lon")), "lat": number(F.col("lat"))})
    good = geo.valid(F.col("lon"), F.col("lat"))
    df = df.withColumns({"good": good, "msg": F.when(F.col("name").isNull(), "too few columns").when(~good, "invalid coordinates")})
    errors = first_error(df.where("msg is not null").select("file", F.col("line_no").alias("line"), "msg"))
    # told within the files' windows, so that places don't need a second scan for the files that failed
    told = df.withColumn("failed", F.count("msg").over(Window.partitionBy("file")) > 0)
    way = told.where("not failed and good").select("file", F.col("line_no").alias("wpt_no"), "lon", "lat", "name", "description")
    return Loaded(waypoints=way, errors=errors).completed(spark)


def read_cup(spark: SparkSession, path: str, glob: str = "*.cup") -> Loaded:
    """Waypoints, then tasks whose turnpoints are looked up by name; elevations in m or ft."""
    from waymark.operators.lookup import named_turnpoints

    rows = lines(spark, path, glob).where("trim(line) <> ''")
    marker = F.lower("line").rlike("^-+related tasks-+").cast("int")
    rows = IN_FILE.summed(rows, tasks_begun=marker)
    rows = rows.withColumn("in_tasks", F.least("tasks_begun", F.lit(1))).where(~F.lower("line").rlike("^-+related tasks-+"))
    fields = F.from_csv("line", F.lit(", ".join(f"c{i} string" for i in range(20))), {"quote": '"'})
    rows = rows.withColumn("c", fields)
    metres = F.when(F.col("c.c5").rlike("(?i)ft$"), 0.3048).otherwise(1.0)
    ele = F.regexp_extract("c.c5", r"^(-?[0-9.]+)", 1).try_cast("double") * metres
    way = rows.where("in_tasks = 0 and c.c0 <> 'name'").select("file", "split", "line_no", F.col("c.c0").alias("name"), texts.cup_angle(F.col("c.c4")).alias("lon"), texts.cup_angle(F.col("c.c3")).alias("lat"), ele.alias("ele"), F.col("c.c10").alias("description"))
    good, errors = split_valid(way, "invalid coordinates")
    good = good.withColumn("wpt_no", F.col("line_no"))
    is_task = "in_tasks = 1 and not (line like 'Options%') and not (line like 'ObsZone%')"
    tasks = rows.where(is_task).select("file", F.col("line_no").alias("task_no"), F.filter(F.array(*[F.col(f"c.c{i}") for i in range(1, 20)]), lambda n: n.isNotNull()).alias("names"))
    route, unknown = named_turnpoints(tasks, good)
    routes = route.select("file", F.col("task_no").alias("route_no"), F.col("place").alias("pt_no"), "lon", "lat", "name")
    missing = unknown.select("file", F.col("task_no").alias("line"), F.concat(F.lit("unknown turnpoint "), F.col("name")).alias("msg"))
    return Loaded(waypoints=good, routepoints=routes, errors=errors.unionByName(missing)).completed(spark)


def read_dashcam(spark: SparkSession, path: str, glob: str = "*.txt") -> Loaded:
    """A $V02 line starts a track; rows of 13 fields with status A; times in epoch seconds, speeds in hundredths."""
    rows = lines(spark, path, glob)
    rows = IN_FILE.summed(rows, begun=F.startswith("line", F.lit("$V02")).cast("int"))
    rows = rows.withColumns({"track_no": F.col("begun") - 1, "f": F.split("line", ",")})
    fixes = rows.where((F.size("f") == 13) & (_part("f", 1) == "A") & (F.col("track_no") >= 0))
    pts = fixes.select(
        "file", "split", "line_no", "track_no", F.lit(0).alias("seg_no"), F.timestamp_seconds(_part("f", 0).try_cast("long")).alias("ts"), number(_part("f", 2)).alias("lat"), number(_part("f", 3)).alias("lon"), (number(_part("f", 4)) * 0.01).alias("speed"), number(_part("f", 6)).alias("ele")
    ).where("not (lon = 0 and lat = 0)")
    good, errors = split_valid(pts, "invalid coordinates")
    return Loaded(trackpoints=_ranked(good, "pt_no", ["file", "track_no"]), errors=errors).completed(spark)


def read_itn(spark: SparkSession, path: str, glob: str = "*.itn") -> Loaded:
    """A route a file: lon, lat in hundred-thousandths of degrees, name; fields end with a bar."""
    rows = lines(spark, path, glob, "ISO-8859-1").where("trim(line) <> ''").withColumn("f", F.split("line", r"\|"))
    pts = rows.select("file", "split", "line_no", F.lit(0).alias("route_no"), (number(_part("f", 0)) / 1e5).alias("lon"), (number(_part("f", 1)) / 1e5).alias("lat"), _part("f", 2).alias("name"))
    good, errors = split_valid(pts, "invalid line")
    return Loaded(routepoints=_ranked(good, "pt_no", ["file"]), errors=errors).completed(spark)


def _titled(rows: DataFrame, title: Column, message: str) -> tuple[DataFrame, DataFrame]:
    """Lines of files whose first line is a title of the format; and an error for each other file."""
    marked = IN_FILE.told(rows, good=F.when(F.col("line_no") == 1, title)).withColumn("good", F.coalesce("good", F.lit(False)))
    return marked.where("good").drop("good"), marked.where("not good and line_no = 1").select("file", F.col("line_no").alias("line"), F.lit(message).alias("msg"))


def _shifted(points: DataFrame, datums: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Places to WGS 84 where a table of datums is given; rows of unknown datums become errors."""
    if datums is None:
        return points, None
    plain = points.where("datum in ('WGS 84', 'WGS84')")
    good, unknown = projection.to_wgs84(points.where("datum not in ('WGS 84', 'WGS84')"), datums)
    return plain.unionByName(good), unknown.select("file", F.col("line_no").alias("line"), F.concat(F.col("datum"), F.lit(": unknown datum")).alias("msg"))


def read_ozi(spark: SparkSession, path: str, kind: str, datums: DataFrame | None = None, glob: str | None = None, rows: DataFrame | None = None) -> Loaded:
    """Track (plt), route (rte) and waypoint (wpt) files: datum in line 2, elevations in feet (-777: none), times as day numbers."""
    rows = lines_of(spark, path, glob or f"*.{kind}", "ISO-8859-1", rows)
    titles = {"plt": "OziExplorer Track Point File", "rte": "OziExplorer Route File", "wpt": "OziExplorer Waypoint File"}
    rows, foreign = _titled(rows, F.startswith(F.trim("line"), F.lit(titles[kind])), f"not a {kind} file")
    rows = IN_FILE.told(rows, datum=F.when(F.col("line_no") == 2, F.trim("line"))).withColumn("f", F.split("line", ","))
    feet = lambda i: F.when(number(_part("f", i)) != -777, number(_part("f", i)) * 0.3048)
    if kind == "plt":
        body = rows.where("line_no > 6 and trim(line) <> ''")
        new = (_part("f", 2) == "1").cast("int")
        pts = body.select("file", "split", "line_no", "datum", F.lit(0).alias("track_no"), number(_part("f", 1)).alias("lon"), number(_part("f", 0)).alias("lat"), feet(3).alias("ele"), texts.day_number_time(number(_part("f", 4))).alias("ts"), new.alias("new"))
        pts = IN_FILE.summed(pts, begun=F.col("new")).withColumn("seg_no", F.greatest(F.col("begun") - 1, F.lit(0))).drop("new", "begun")
    elif kind == "rte":
        body = rows.where(_part("f", 0) == "W")
        pts = body.select("file", "split", "line_no", "datum", number(_part("f", 1)).cast("int").alias("route_no"), number(_part("f", 6)).alias("lon"), number(_part("f", 5)).alias("lat"), _part("f", 4).alias("name"))
    else:
        body = rows.where("line_no > 4 and trim(line) <> ''")
        pts = body.select("file", "split", "line_no", "datum", number(_part("f", 3)).alias("lon"), number(_part("f", 2)).alias("lat"), _part("f", 1).alias("name"), _part("f", 10).alias("description"), feet(14).alias("ele"), texts.day_number_time(number(_part("f", 4))).alias("ts"), F.col("line_no").alias("wpt_no"))
    good, errors = split_valid(pts, "invalid coordinates")
    good, unknown = _shifted(good, datums)
    errors = foreign.unionByName(errors if unknown is None else errors.unionByName(unknown))
    if kind == "plt":
        return Loaded(trackpoints=_ranked(good, "pt_no", ["file", "seg_no"]), errors=errors).completed(spark)
    if kind == "rte":
        return Loaded(routepoints=_ranked(good, "pt_no", ["file", "route_no"]), errors=errors).completed(spark)
    return Loaded(waypoints=good, errors=errors).completed(spark)


def read_twonav(spark: SparkSession, path: str, kind: str = "trk", datums: DataFrame | None = None, glob: str | None = None, rows: DataFrame | None = None) -> Loaded:
    """Records by letter: G sets the datum of later lines, U the projection, T are trackpoints, W waypoints, and R begins a route of the waypoints after it.

    A file without such records is an error.
    """
    rows = lines_of(spark, path, glob or f"*.{kind}", "ISO-8859-1", rows).withColumn("f", F.split(F.trim("line"), r"\s+"))
    rows = IN_FILE.filled(rows, datum=F.when(F.col("line").rlike("^G "), F.trim(F.substr("line", F.lit(3)))))
    rows = rows.withColumns({"datum": F.coalesce("datum", F.lit("WGS 84")), "letter": F.left(F.trim("line"), F.lit(1))})
    rows = IN_FILE.summed(rows, routes=(F.col("letter") == "R").cast("int")).withColumn("route_no", F.col("routes") - 1)
    nothing = IN_FILE.told(rows, known=F.col("letter").isin("T", "W", "R")).withColumn("known", F.coalesce("known", F.lit(False))).where("not known and line_no = 1").select("file", F.col("line_no").alias("line"), F.lit("no valid data found").alias("msg"))
    at = F.when(F.col("letter") == "T", 2).otherwise(3)
    rows = rows.where("letter in ('T', 'W')").withColumns(
        {"lat": texts.marked_angle(F.get("f", at), "N", "S"), "lon": texts.marked_angle(F.get("f", at + 1), "E", "W"), "at": at}
    )
    ts = F.try_to_timestamp(F.concat_ws(" ", F.get("f", F.col("at") + 2), F.get("f", F.col("at") + 3)), F.lit("dd-MMM-yy HH:mm:ss"))
    rows = rows.withColumn("ts", ts).withColumn("ele", number(F.get("f", F.lit(7))))
    rows = rows.withColumns({"name": F.trim(F.translate(_part("f", 1), "_", " ")), "description": F.when((F.col("letter") == "W") & (F.size("f") > 8), F.array_join(F.slice("f", F.lit(9), F.size("f")), " "))})
    good, errors = split_valid(rows, "invalid coordinates")
    good, unknown = _shifted(good.drop("f", "at"), datums)
    errors = nothing.unionByName(errors if unknown is None else errors.unionByName(unknown))
    tracks = _ranked(good.where("letter = 'T'"), "pt_no", ["file"]).withColumns({"track_no": F.lit(0), "seg_no": F.lit(0)})
    way = good.where("letter = 'W' and route_no < 0").withColumn("wpt_no", F.col("line_no"))
    route = _ranked(good.where("letter = 'W' and route_no >= 0"), "pt_no", ["file", "route_no"])
    return Loaded(trackpoints=tracks, waypoints=way, routepoints=route, errors=errors).completed(spark)


def read_gpsdump(spark: SparkSession, path: str, glob: str = "*.wpt", rows: DataFrame | None = None) -> Loaded:
    """Waypoint lists: the header says whether places are geographic or UTM; fields are two blanks or more apart."""
    rows = lines_of(spark, path, glob, "UTF-8", rows)
    rows, foreign = _titled(rows, F.trim("line").isin("$FormatGEO", "$FormatUTM"), "not a waypoint list")
    rows = IN_FILE.told(rows, grammar=F.when(F.col("line_no") == 1, F.right(F.trim("line"), F.lit(3))))
    rows = rows.withColumn("f", F.split(F.trim("line"), r" {2,}")).where("line_no > 1 and trim(line) <> ''")

    def angle(text: Column) -> Column:
        part = F.split(F.trim(text), r"[\s°']+")
        value = F.get(part, F.lit(1)).try_cast("double") + F.coalesce(F.get(part, F.lit(2)).try_cast("double"), F.lit(0.0)) / 60.0 + F.coalesce(F.get(part, F.lit(3)).try_cast("double"), F.lit(0.0)) / 3600.0
        return value * F.when(part[0].isin("S", "W"), -1.0).otherwise(1.0)

    zone_text = _part("f", 1)
    zone = F.regexp_extract(zone_text, r"^(\d+)", 1).try_cast("int") * F.when(F.upper(F.right(zone_text, F.lit(1))) < "N", -1).otherwise(1)
    is_utm = F.col("grammar") == "UTM"
    rows = rows.withColumns({"zone": F.when(is_utm, zone), "x": F.when(is_utm, number(_part("f", 2))), "y": F.when(is_utm, number(_part("f", 3)))})
    u_lon, u_lat = projection.from_utm(F.col("zone"), F.col("x"), F.col("y"))
    pts = rows.select(
        "file", "split", "line_no", F.col("line_no").alias("wpt_no"), _part("f", 0).alias("name"),
        # from a generator: filters on the places, which name them several times, stay above these long expressions
        F.inline(F.array(F.struct(F.when(is_utm, u_lon).otherwise(angle(F.get("f", F.lit(2)))).alias("lon"), F.when(is_utm, u_lat).otherwise(angle(F.get("f", F.lit(1)))).alias("lat")))),
        F.when(is_utm, number(_part("f", 4))).otherwise(number(_part("f", 3))).alias("ele"), F.when(is_utm, _part("f", 5)).otherwise(_part("f", 4)).alias("description"),
    )
    good, errors = split_valid(pts, "invalid coordinates")
    return Loaded(waypoints=good, errors=foreign.unionByName(errors)).completed(spark)


def read_igc(spark: SparkSession, path: str, glob: str = "*.igc") -> Loaded:
    """B records with validity A; the date of the H record, or 1970-01-01, goes on a day where the time goes back; C records are the task."""
    rows = lines(spark, path, glob)
    date_text = F.regexp_extract("line", r"^HFDTE(?:DATE:)?\s*(\d{6})", 1)
    year = F.substr(date_text, F.lit(5), F.lit(2)).try_cast("int")
    date = F.when(date_text != "", F.make_date(F.when(year < 80, year + 2000).otherwise(year + 1900), F.substr(date_text, F.lit(3), F.lit(2)).try_cast("int"), F.substr(date_text, F.lit(1), F.lit(2)).try_cast("int")))
    rows = IN_FILE.filled(rows, day=date).withColumn("day", F.coalesce("day", F.lit("1970-01-01").cast("date")))
    cut = lambda at, n: F.substr("line", F.lit(at), F.lit(n))
    fixes = rows.where(F.col("line").rlike(r"^B\d{6}\d{7}[NS]\d{8}[EW]A")).withColumn("tod", cut(2, 2).cast("int") * 3600 + cut(4, 2).cast("int") * 60 + cut(6, 2).cast("int"))
    fixes = IN_FILE.previous(fixes, "earlier", F.col("tod"))
    fixes = IN_FILE.summed(fixes, days=F.coalesce(F.col("tod") < F.col("earlier"), F.lit(False)).cast("int"))
    pts = fixes.select(
        "file", "split", "line_no", F.lit(0).alias("track_no"), F.lit(0).alias("seg_no"), texts.igc_angle(cut(16, 9)).alias("lon"), texts.igc_angle(cut(8, 8)).alias("lat"), cut(31, 5).try_cast("double").alias("ele"),
        F.timestamp_seconds(F.unix_seconds(F.date_add("day", F.col("days").cast("int")).cast("timestamp")) + F.col("tod")).alias("ts"),
    )
    good, errors = split_valid(pts, "invalid coordinates")
    task = rows.where(F.col("line").rlike(r"^C\d{7}[NS]\d{8}[EW]")).select("file", "split", "line_no", F.lit(0).alias("route_no"), texts.igc_angle(cut(10, 9)).alias("lon"), texts.igc_angle(cut(2, 8)).alias("lat"), F.trim(F.substr("line", F.lit(19))).alias("name"))
    task = task.where("not (lon = 0 and lat = 0)")
    return Loaded(trackpoints=_ranked(good, "pt_no", ["file"]), routepoints=_ranked(task, "pt_no", ["file"]), errors=errors).completed(spark)


def read_srt(spark: SparkSession, path: str, glob: str = "*.srt") -> Loaded:
    """Drone subtitles in two dialects; in the newer one a place equal to the one before it is dropped."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).format("binaryFile").load(path).select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("value"))
    blocks = raw.select("file", F.posexplode(F.split("value", r"(?:\r?\n){2,}")).alias("line_no", "block")).where("trim(block) <> ''")
    num = r"([-+]?[0-9]+(?:\.[0-9]+)?)"
    new_lat, new_lon, new_ele = (F.regexp_extract("block", p, 1) for p in (rf"\[latitude\s*:\s*{num}\]", rf"\[long?t?itude\s*:\s*{num}\]", rf"abs_alt\s*:\s*{num}"))
    old = rf"GPS\s*\(\s*{num}\s*,\s*{num}\s*,?\s*{num}?"
    newer = new_lat != ""
    lon, lat = (F.when(newer, n).otherwise(F.regexp_extract("block", old, i)) for n, i in ((new_lon, 1), (new_lat, 2)))
    ele = F.when(newer, new_ele).otherwise(F.regexp_extract("block", rf"BAROMETER\s*:\s*{num}", 1))
    ts = F.try_to_timestamp(F.replace(F.replace(F.regexp_extract("block", r"(\d{4}[-.]\d{2}[-.]\d{2} \d{2}:\d{2}:\d{2}(?:[.,]\d{1,3})?)", 1), F.lit(","), F.lit(".")), F.lit("~"), F.lit("")))
    pts = blocks.select("file", "line_no", newer.alias("newer"), F.lit(0).alias("track_no"), F.lit(0).alias("seg_no"), number(lon).alias("lon"), number(lat).alias("lat"), number(ele).alias("ele"), ts.alias("ts"))
    pts = pts.where(geo.valid(F.col("lon"), F.col("lat")))
    before = F.lag(F.struct("lon", "lat")).over(in_file())
    same = F.coalesce(F.col("newer") & (before["lon"] == F.col("lon")) & (before["lat"] == F.col("lat")), F.lit(False))
    kept = pts.withColumn("same", same).where("not same").drop("same", "newer")
    return Loaded(trackpoints=numbered(kept, "pt_no", ["file"], "line_no")).completed(spark)


def geo_uri(column: Column) -> Column:
    """struct<lon, lat, ele> of geo:lat,lon[,ele][;crs=...]; null if malformed or in another system than WGS 84."""
    body = F.regexp_extract(column, r"^geo:([^;]*)", 1)
    crs = F.lower(F.regexp_extract(column, r";crs=([^;]*)", 1))
    v = F.split(body, ",")
    lat, lon = number(F.get(v, F.lit(0))), number(F.get(v, F.lit(1)))
    good = geo.valid(lon, lat) & crs.isin("", "wgs84")
    return F.when(good, F.struct(lon.alias("lon"), lat.alias("lat"), number(F.get(v, F.lit(2))).alias("ele")))
