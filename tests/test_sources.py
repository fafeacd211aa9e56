"""Golden files of each format: valid rows, a truncated or wrong one, one out of range."""

import random
import struct

import pytest

from waymark.sources import common, files, geojson, nmea, pull, terrain, text, xml

GPX = """<?xml version="1.0"?><gpx xmlns:gpxtpx="urn:x"><wpt lat="50.1" lon="14.2"><ele>200</ele><name>Hut</name><link href="http://a"><text>A</text></link></wpt>
<wpt lat="95" lon="14.2"><name>bad</name></wpt>
<rte><name>R</name><rtept lat="50" lon="14"><extensions><RoutePointExtension><rpt lat="50.01" lon="14.01"/></RoutePointExtension></extensions></rtept><rtept lat="50.1" lon="14.1"/></rte>
<trk><name>T</name><trkseg><trkpt lat="50" lon="14"><ele>210</ele><geoidheight>10</geoidheight><time>2024-01-01T10:00:00Z</time><extensions><gpxtpx:TrackPointExtension><gpxtpx:hr>120</gpxtpx:hr><gpxtpx:wtemp>9</gpxtpx:wtemp></gpxtpx:TrackPointExtension></extensions></trkpt>
<trkpt lat="50.001" lon="14"><time>2024-01-01T10:00:10Z</time></trkpt></trkseg><trkseg><trkpt lat="51" lon="14"/></trkseg></trk>
<extensions><area><name>Ar</name><polygon><linearRing><point lat="1" lon="1"/><point lat="1" lon="2"/><point lat="2" lon="2"/></linearRing></polygon></area></extensions></gpx>"""


def write(folder, name, content):
    (folder / name).write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(folder)


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_gpx(spark, tmp_path):
    out = xml.read_gpx(spark, write(tmp_path, "a.gpx", GPX))
    points = sorted(rows(out.trackpoints, "track_no", "seg_no", "pt_no", "lat", "ele", "heart_rate", "temperature"))
    assert points[:3] == [(0, 0, 0, 50.0, 200.0, 120.0, 9.0), (0, 0, 1, 50.001, None, None, None), (0, 1, 0, 51.0, None, None, None)]
    assert [p[:4] for p in points[3:]] == [(1000000, 0, 0, 50.0), (1000000, 0, 1, 50.01), (1000000, 0, 2, 50.1)]
    assert rows(out.waypoints, "name", "ele", "links") == [("Hut", 200.0, [("http://a", "A")])]
    assert rows(out.errors, "msg") == [("invalid coordinates in waypoints",)]
    assert sorted(rows(out.routepoints, "pt_no", "lat")) == [(0, 50.0), (1, 50.1)]
    assert rows(out.areas, "name", "west", "north") == [("Ar", 1.0, 2.0)]


def test_tcx(spark, tmp_path):
    point = "<Trackpoint><Time>2024-01-01T10:00:0{0}Z</Time><Position><LatitudeDegrees>50.{0}</LatitudeDegrees><LongitudeDegrees>14</LongitudeDegrees></Position><HeartRateBpm><Value>9{0}</Value></HeartRateBpm></Trackpoint>"
    lap = "<Lap><Track>{}</Track></Lap>"
    body = f"<TrainingCenterDatabase><Activities><Activity><Id>x</Id>{lap.format(point.format(1))}{lap.format(point.format(2) + '<Trackpoint><Time>2024-01-01T10:00:09Z</Time></Trackpoint>')}</Activity></Activities><Courses><Course><Name>c</Name><Track>{point.format(3)}</Track><CoursePoint><Name>P</Name><Position><LatitudeDegrees>1</LatitudeDegrees><LongitudeDegrees>2</LongitudeDegrees></Position></CoursePoint></Course></Courses></TrainingCenterDatabase>"
    out = xml.read_tcx(spark, write(tmp_path, "a.tcx", body))
    assert sorted(rows(out.trackpoints, "track_no", "seg_no", "pt_no", "lat", "heart_rate")) == [(0, 0, 0, 50.1, 91.0), (0, 0, 1, 50.2, 92.0), (1000000, 0, 0, 50.3, 93.0)]
    assert rows(out.waypoints, "name", "lon") == [("P", 2.0)]


def test_kml(spark, tmp_path):
    gx = "<gx:Track><when>2024-01-01T00:00:00Z</when><when>2024-01-01T00:00:05Z</when><gx:coord>14 50 200</gx:coord>{}<ExtendedData><SchemaData><gx:SimpleArrayData name='heartrate'><gx:value>80</gx:value><gx:value>90</gx:value></gx:SimpleArrayData></SchemaData></ExtendedData></gx:Track>"
    body = f"""<kml xmlns:gx="urn:g"><Document><Folder><Placemark><name>P</name><Point><coordinates>14,50,100</coordinates></Point></Placemark>
<Placemark><LineString><coordinates>1,2 3,4,5</coordinates></LineString></Placemark>
<Placemark>{gx.format('<gx:coord>14.1 50.1</gx:coord>')}</Placemark><Placemark>{gx.format('')}</Placemark>
<Placemark><name>Q</name><Polygon><outerBoundaryIs><LinearRing><coordinates>0,0 1,0 1,1</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></Folder></Document></kml>"""
    out = xml.read_kml(spark, write(tmp_path, "a.kml", body))
    assert rows(out.waypoints, "name", "ele") == [("P", 100.0)]
    assert sorted(rows(out.trackpoints, "track_no", "pt_no", "lon", "heart_rate")) == [(1, 0, 1.0, None), (1, 1, 3.0, None), (2, 0, 14.0, 80.0), (2, 1, 14.1, 90.0)]
    assert rows(out.errors, "msg") == [("times and places differ in number",)]
    assert rows(out.areas, "name", "east") == [("Q", 1.0)]


def test_slf_sml_loc(spark, tmp_path):
    write(tmp_path, "a.slf", '<Activity><GeneralInformation><startDate>Mon Jan 1 10:00:00 GMT+0000 2024</startDate></GeneralInformation><Entries><Entry altitude="200000" heartrate="99" latitude="50" longitude="14" trainingTimeAbsolute="150"/><Entry latitude="0" longitude="0"/></Entries></Activity>')
    write(tmp_path, "a.loc", '<loc><waypoint><name id="GC1"><![CDATA[Cache]]></name><coord lat="50" lon="14"/><link text="T">http://x</link></waypoint></loc>')
    write(tmp_path, "a.sml", "<sml><DeviceLog><Samples><Sample><UTC>2024-01-01T10:00:00Z</UTC><Latitude>0.8726646259971648</Latitude><Longitude>0.24434609527920614</Longitude></Sample><Sample><UTC>2024-01-01T10:00:01Z</UTC><HR>2</HR><Temperature>283.15</Temperature></Sample></Samples></DeviceLog></sml>")
    slf = rows(xml.read_slf(spark, str(tmp_path)).trackpoints, "ele", "heart_rate", "ts")
    assert [(e, h, t.isoformat()) for e, h, t in slf] == [(200.0, 99.0, "2024-01-01T10:00:01.500000")]
    assert rows(xml.read_loc(spark, str(tmp_path)).waypoints, "name", "description") == [("GC1", "Cache")]
    (p,) = rows(xml.read_sml(spark, str(tmp_path)).trackpoints, "lat", "heart_rate", "temperature")
    assert p == pytest.approx((50.0, 120.0, 10.0))


def test_geojson(spark, tmp_path):
    body = """{"type":"FeatureCollection","features":[
{"type":"Feature","properties":{"name":"n","title":"t"},"geometry":{"type":"Point","coordinates":[14,50,7]}},
{"type":"Feature","properties":{"coordinateProperties":{"times":["2024-01-01T00:00:00Z",1704067205000],"heart":[80,90]}},"geometry":{"type":"LineString","coordinates":[[14,50],[14.1,50]]}},
{"type":"Feature","properties":{},"geometry":{"type":"GeometryCollection","geometries":[{"type":"MultiLineString","coordinates":[[[1,1],[2,2]],[[3,3],[4,4]]]},{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}]}},
{"type":"Feature","properties":{},"geometry":{"type":"Point","coordinates":[1558472.8711,6446275.8411],"crs":{"type":"name","properties":{"name":"urn:ogc:def:crs:EPSG::3857"}}}}]}"""
    write(tmp_path, "b.geojson", '{"type":"Point","coordinates":[500,50]}')
    out = geojson.read_geojson(spark, write(tmp_path, "a.geojson", body))
    way = sorted(rows(out.waypoints, "lon", "lat", "ele", "name"), key=lambda r: r[0] if r[3] else 99)
    assert way[0] == (14.0, 50.0, 7.0, "t") and way[1][:2] == pytest.approx((14.0, 50.0), abs=1e-5)
    pts = sorted(rows(out.trackpoints, "track_no", "seg_no", "pt_no", "lon", "heart_rate"))
    assert pts[:2] == [(1000, 0, 0, 14.0, 80.0), (1000, 0, 1, 14.1, 90.0)] and [p[1] for p in pts[2:]] == [0, 0, 1, 1]
    assert rows(out.trackpoints.where("track_no = 1000").orderBy("pt_no"), "ts")[1][0].isoformat() == "2024-01-01T00:00:05"
    assert rows(out.areas, "east") == [(1.0,)] and rows(out.errors, "msg") == [("invalid coordinates",)]


def test_csv_and_quarantine(spark, tmp_path):
    write(tmp_path, "a.csv", '14,50,"A, ""b""",d\n15,51,C\n')
    write(tmp_path, "b.csv", "14,50,A\n14,99,B\n")
    out = text.read_csv(spark, str(tmp_path))
    assert sorted(rows(out.waypoints, "name", "lon")) == [('A, "b"', 14.0), ("C", 15.0)]
    assert [(f.endswith("b.csv"), n, m) for f, n, m in rows(out.errors, "file", "line", "msg")] == [(True, 2, "invalid coordinates")]


def test_csv_is_read_once(spark, tmp_path):
    """failed files are told in the scan that reads the places; a file fails by its first bad row, wherever the row is."""
    write(tmp_path, "a.csv", '14,50,"A\nB",d\n15,51,C\n')
    write(tmp_path, "b.csv", "14,50,A\n14,50\n14,99,B\n")
    write(tmp_path, "c.csv", "x,50,A\n14,50,B\n")
    out = text.read_csv(spark, str(tmp_path))
    assert out.waypoints._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    assert sorted(rows(out.waypoints, "wpt_no", "name", "description")) == [(1, "A\nB", "d"), (2, "C", None)]
    assert sorted((f[-5:], n, m) for f, n, m in rows(out.errors, "file", "line", "msg")) == [("b.csv", 2, "too few columns"), ("c.csv", 1, "invalid coordinates")]


def test_cup(spark, tmp_path):
    body = 'name,code,country,lat,lon,elev,style,rwdir,rwlen,freq,desc\n"A",a,CZ,5007.500N,01430.000E,300.0m,1,,,,x\n"B",b,CZ,5000.000S,01400.000W,1000ft,1,,,,y\n-----Related Tasks-----\n"T","???","A","B","Z"\nOptions,x\n'
    out = text.read_cup(spark, write(tmp_path, "a.cup", body))
    assert sorted(rows(out.waypoints, "name", "lat", "lon", "ele")) == [("A", 50.125, 14.5, 300.0), ("B", -50.0, -14.0, 304.8)]
    assert sorted(rows(out.routepoints, "pt_no", "name")) == [(1, "A"), (2, "B")]
    assert rows(out.errors, "msg") == [("unknown turnpoint Z",)]


def test_line_formats(spark, tmp_path):
    write(tmp_path, "a.txt", "$V02\n1704067200,A,50,14,300,0,210,0,0,0,0,0,0\n1704067201,V,50,14,300,0,210,0,0,0,0,0,0\n1704067202,A,0,0,300,0,210,0,0,0,0,0,0\n$V02\n1704067203,A,51,15,500,0,1,0,0,0,0,0,0\n")
    out = text.read_dashcam(spark, str(tmp_path)).trackpoints
    assert sorted(rows(out, "track_no", "lat", "speed", "ele")) == [(0, 50.0, 3.0, 210.0), (1, 51.0, 5.0, 1.0)]
    write(tmp_path, "a.itn", "1400000|5000000|A|0|\n1500000|9900000|B|0|\n")
    itn = text.read_itn(spark, str(tmp_path))
    assert rows(itn.routepoints, "lon", "lat", "name") == [(14.0, 50.0, "A")] and rows(itn.errors, "line") == [(2,)]
    write(tmp_path, "a.plt", "OziExplorer Track Point File Version 2.1\nWGS 84\nAltitude is in Feet\nReserved 3\n0,2,255,x,0,0,2,8421376\n2\n50.0,14.0,1,-777,45292.5,,\n50.1,14.1,0,1000,45292.6,,\n51.0,14.0,1,10,45292.7,,\n")
    plt = sorted(rows(text.read_ozi(spark, str(tmp_path), "plt").trackpoints, "seg_no", "pt_no", "ele", "ts"))
    assert [(s, p, e) for s, p, e, _ in plt] == [(0, 0, None), (0, 1, pytest.approx(304.8)), (1, 0, pytest.approx(3.048))]
    assert plt[0][3].isoformat() == "2024-01-01T12:00:00"


def test_twonav_and_gpsdump(spark, tmp_path):
    write(tmp_path, "a.trk", "B UTF-8\nG WGS 84\nU 1\nT A 50.5ºN 14.5ºE 01-JAN-24 10:00:00 s 211.0 0\nW P A 50.6ºN 14.6ºW 01-JAN-24 10:00:00 5 text\n".encode("latin-1"))
    out = text.read_twonav(spark, str(tmp_path))
    assert rows(out.trackpoints, "lat", "lon", "ele") == [(50.5, 14.5, 211.0)] and rows(out.waypoints, "name", "lon") == [("P", -14.6)]
    write(tmp_path, "a.wpt", "$FormatUTM\nA          33U   458731   5548745   200   Hut\n")
    (w,) = rows(text.read_gpsdump(spark, str(tmp_path)).waypoints, "name", "lon", "lat", "ele")
    assert w[0] == "A" and w[3] == 200 and 14 < w[1] < 15 and 50 < w[2] < 50.2


def test_nmea(spark, tmp_path):
    body = "$GPWPL,5000.00,N,01400.00,E,HOME*55\n$GPRMC,235958,A,5000.00,N,01400.00,E,0,0,311223,,*00\n$GPGGA,235959,5001.00,N,01400.00,E,1,8,1,200,M,45,M,,*00\n$GPRMC,235959,A,5009.00,N,01400.00,E,0,0,311223,,*00\n$GPGGA,000001,5002.00,N,01400.00,E,1,8,1,201,M,45,M,,*00\n$GPGGA,000002,9902.00,N,01400.00,E,1,8,1,201,M,45,M,,*00\n"
    out = nmea.read_nmea(spark, write(tmp_path, "a.nmea", body))
    points = [(t.isoformat(), round(lat, 4)) for t, lat in rows(out.trackpoints.orderBy("pt_no"), "ts", "lat")]
    assert points == [("2023-12-31T23:59:58", 50.0), ("2023-12-31T23:59:59", 50.0167), ("2024-01-01T00:00:01", 50.0333)]
    assert rows(out.waypoints, "name") == [("HOME",)]


def test_igc(spark, tmp_path):
    body = "AXXX\nHFDTE311223\nC5000000N01400000ESTART\nC0000000N00000000ENONE\nB2359595000000N01400000EA0010000200\nB0000015030000N01430000EA0010000210\nB0000025030000N01430000EV0010000210\n"
    out = text.read_igc(spark, write(tmp_path, "a.igc", body))
    assert [(t.isoformat(), lat, e) for t, lat, e in rows(out.trackpoints.orderBy("pt_no"), "ts", "lat", "ele")] == [("2023-12-31T23:59:59", 50.0, 200.0), ("2024-01-01T00:00:01", 50.5, 210.0)]
    assert rows(out.routepoints, "name", "lat") == [("START", 50.0)]


def test_srt(spark, tmp_path):
    block = "{}\n00:00:0{} --> 00:00:01\n2024-01-01 10:00:0{}.500\n[latitude: 50.{}] [longitude: 14.0] abs_alt: 200.5]\n\n"
    body = block.format(1, 1, 1, 1) + block.format(2, 2, 2, 1) + block.format(3, 3, 3, 2)
    write(tmp_path, "b.srt", "1\n00:00:01 --> 00:00:02\nGPS(14.5,50.5,18) BAROMETER:31.4\n")
    out = text.read_srt(spark, write(tmp_path, "a.srt", body)).trackpoints
    assert sorted(rows(out, "lat", "ele")) == [(50.1, 200.5), (50.2, 200.5), (50.5, 31.4)]


def test_geo_uri(spark):
    df = spark.createDataFrame([("geo:50.1,14.2,300",), ("geo:50,14;crs=wgs84;u=5",), ("geo:99,14",), ("geo:1,2;crs=x",), (None,)], "uri string")
    got = [r[0] for r in df.select(text.geo_uri(df.uri)).collect()]
    assert tuple(got[0]) == (14.2, 50.1, 300.0) and tuple(got[1]) == (14.0, 50.0, None) and got[2:] == [None] * 3


def test_hgt_and_tables(spark, tmp_path):
    write(tmp_path, "N50E014.hgt", struct.pack(">9h", 1, 2, 3, 4, -32768, 6, 7, 8, 9))
    write(tmp_path, "S01W002.hgt", b"\0\0\0")
    got = sorted(rows(terrain.read_hgt(spark, str(tmp_path)), "tile_lat", "row", "col", "z"))
    assert got[0] == (50, 0, 0, 7) and got[4] == (50, 1, 1, None) and len(got) == 9
    write(tmp_path, "e.csv", "Bessel,7004,6377397.155,299.1528128\nbad,x,1,2\n")
    write(tmp_path, "g.csv", "ED50,4230,6230,9102,7004,8901,9603,-87,-98,-121,,,,\nbad,1,,,,,,\n")
    table = terrain.datum_table(terrain.read_datums(spark, f"{tmp_path}/g.csv"), terrain.read_ellipsoids(spark, f"{tmp_path}/e.csv"))
    assert rows(table, "datum", "dx", "rx", "radius") == [("ED50", -87.0, 0.0, 6377397.155)]


def test_dispatch(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    write(tmp_path / "sub", "a.gpx", GPX)
    write(tmp_path, "b.csv", "14,50,A\n")
    write(tmp_path, "c.unknown", "?")
    out = files.read(spark, str(tmp_path))
    assert sorted(r[0] for r in rows(out.waypoints, "name")) == ["A", "Hut"] and out.trackpoints.count() == 6
    assert [(f.rpartition("/")[2], m) for f, m in rows(out.errors, "file", "msg") if m == "unknown format"] == [("c.unknown", "unknown format")]


def test_dialects_of_one_extension(spark, tmp_path):
    write(tmp_path, "dump.wpt", "$FormatGEO\nA  N 50 30.0  E 14 30.0  200\n")
    write(tmp_path, "nav.wpt", "B UTF-8\nG WGS 84\nU 1\nW P A 50.6N 14.6W 01-JAN-24 10:00:00 5 text\n")
    write(tmp_path, "ozi.wpt", "OziExplorer Waypoint File Version 1.1\nWGS 84\nReserved 2\nReserved 3\n1,Q,50.1,14.1,45000.5,0,1,3,0,65535,text,0,0,0,-777\n")
    write(tmp_path, "bad.wpt", "nothing that anyone knows\n")
    write(tmp_path, "nav.rte", "B UTF-8\nG WGS 84\nU 1\nR 255,r\nW S A 50.6N 14.6E 01-JAN-24 10:00:00 5 text\n")
    write(tmp_path, "ozi.rte", "OziExplorer Route File Version 1.0\nWGS 84\nReserved 1\nReserved 2\nR,0,r,d,255\nW,0,1,1,T,50.2,14.2,45000.5,0,1,3,0,65535,,0,0\n")
    write(tmp_path, "map.json", '{"type":"Point","coordinates":[14,50]}')
    out = files.read(spark, str(tmp_path))
    assert sorted(r[0] or "" for r in rows(out.waypoints, "name")) == ["", "A", "P", "Q"]
    assert sorted(r[0] for r in rows(out.routepoints, "name")) == ["S", "T"]
    assert [(f.rpartition("/")[2], m) for f, m in rows(out.errors, "file", "msg")] == [("bad.wpt", "not a wpt file")]


def _rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def test_a_file_in_many_splits(spark, tmp_path):
    """Dates, GGA seen, midnights, datums and track numbers go on from split to split."""
    rng = random.Random(5)
    nmea_lines, igc, cam, plt = [], ["AXXX", "HFDTE311223"], [], ["OziExplorer Track Point File Version 2.1", "WGS 84", "x", "x", "x", "x"]
    for i in range(120):
        tod, at = (86_000 + 37 * i) % 86_400, f"{5000 + i * 0.01:07.2f},N,01400.00,E"
        clock = f"{tod // 3600:02d}{tod // 60 % 60:02d}{tod % 60:02d}"
        if i % 40 == 3:
            nmea_lines.append(f"$GPRMC,{clock},A,{at},0,0,{27 + i // 40:02d}1223,,*00")
        nmea_lines.append(f"$GPGGA,{clock},{at},1,8,1,{200 + i},M,45,M,,*00" if i > 20 else rng.choice(["$GPGSV,1", "", f"$GPRMC,{clock},A,{at},0,0,,,*00"]))
        igc.append(f"B{clock}50{i:05d}N014{i:05d}EA0010000{i:03d}")
        cam.append("$V02" if i % 30 == 0 else f"{1700000000 + i},A,50.{i:03d},14.0,100,0,{i},0,0,0,0,0,0")
        plt.append(f" 50.{i:03d}, 14.0,{int(i % 25 == 0)}, 300, 45000.{i:03d}, , ")
    files = {"nmea": nmea_lines, "igc": igc, "txt": cam, "plt": plt}
    readers = {"nmea": nmea.read_nmea, "igc": text.read_igc, "txt": text.read_dashcam, "plt": lambda s, p: text.read_ozi(s, p, "plt")}
    for kind, lines in files.items():
        for k, end in enumerate(["\n", "\r\n"]):
            (tmp_path / f"{k}.{kind}").write_bytes(end.join(lines).encode() + end.encode() * k)
    for kind, read in readers.items():
        whole = _rows(read(spark, str(tmp_path)).trackpoints)
        assert len(whole) >= 200
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            numbered = common.lines(spark, str(tmp_path), f"*.{kind}")
            assert numbered.select("file", "split").distinct().count() > 6
            got = {r.line_no: r.line for r in numbered.collect() if r.file.endswith(f"0.{kind}")}
            assert [got[n] for n in sorted(got)] == files[kind]
            parts = _rows(read(spark, str(tmp_path)).trackpoints)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert parts == whole


def test_lines_and_encodings(spark, tmp_path):
    (tmp_path / "latin.txt").write_bytes("é\nß".encode("latin-1"))
    got = {(r.file.rsplit("/", 1)[1], r.line_no): r.line for r in common.lines(spark, str(tmp_path), "*.txt", "ISO-8859-1").collect()}
    assert got == {("latin.txt", 1): "é", ("latin.txt", 2): "ß"}


def test_dialects_are_told_by_one_scan(spark, tmp_path):
    """Files of an extension are read once; a refused one goes on, and the plans of all outputs read what was kept."""
    ozi = "OziExplorer Waypoint File Version 1.1\nNAD27\nReserved 2\nReserved 3\n1,A,50.0,14.0,45000.5,0,1,3,0,65535,text,0,0,0,-777\n"
    (tmp_path / "ozi.wpt").write_text(ozi)
    (tmp_path / "list.wpt").write_text("$FormatGEO\nB  N 50 0  E 14 0  200  x\n")
    (tmp_path / "wrong.wpt").write_text("$FormatGEO\nB  N 95 0  E 14 0  200  x\n")
    (tmp_path / "nav.wpt").write_text("G WGS 84\nW C A 50.0N 14.0E 01-JAN-24 10:00:00 5.0 x\n")
    (tmp_path / "none.wpt").write_text("hello\n")
    out = files.read(spark, str(tmp_path))
    assert sorted(r.name for r in out.waypoints.collect()) == ["A", "B", "C"]
    assert sorted((r.file.rsplit("/", 1)[1], r.msg) for r in out.errors.collect()) == [("none.wpt", "not a wpt file"), ("wrong.wpt", "not a wpt file")]
    for df in (out.trackpoints, out.routepoints, out.waypoints, out.areas, out.errors):
        assert "FileScan text" not in df._jdf.queryExecution().executedPlan().toString()


def test_xml_is_parsed_once(spark, tmp_path):
    """One pass gives the rows of all tags; the plans of all outputs read what it kept. Splits don't matter, and what isn't well-formed is an error with its line."""
    points = "".join(f'<trkpt lat="50.{i:03d}" lon="14"><ele>{i}</ele></trkpt>\n' for i in range(200))
    whole = f'<?xml version="1.0"?>\n<gpx xmlns:x="urn:x">\n<wpt lat="1" lon="2"><name>A &amp; "B" &lt;c&gt;</name></wpt>\n<trk><trkseg>\n{points}</trkseg><trkseg/><trkseg><trkpt lat="51" lon="14"/></trkseg></trk>\n<trk><trkseg><trkpt lat="52" lon="14"><extensions><x:hr>99</x:hr></extensions></trkpt></trkseg></trk></gpx>'
    (tmp_path / "a.gpx").write_text(whole)
    (tmp_path / "cut.gpx").write_text(whole[:2000])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        out = xml.read_gpx(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for df in (out.trackpoints, out.routepoints, out.waypoints, out.areas, out.errors):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "FileScan" not in plan and "MapInArrow" not in plan
    got = {(r.track_no, r.seg_no, r.pt_no): r for r in out.trackpoints.collect() if r.file.endswith("a.gpx")}
    assert len(got) == 202 and got[0, 0, 199].ele == 199 and got[0, 2, 0].lat == 51 and got[1, 0, 0].heart_rate == 99
    assert {r.name for r in out.waypoints.collect()} == {'A & "B" <c>'}
    (error,) = out.errors.collect()
    assert error.file.endswith("cut.gpx") and error.line == whole[:2000].count("\n") + 1


def test_pulled_elements(spark, tmp_path):
    (tmp_path / "a.xml").write_bytes('<?xml version="1.0" encoding="ISO-8859-1"?><r><b i="1">é<b i="2"/></b><g><b/><c/><b>x</b></g></r>'.encode("latin-1"))
    (tmp_path / "b.xml").write_text("no xml")
    found = pull.elements(spark, str(tmp_path), "*.xml", {"b": ("g",)}).collect()
    assert sorted((r.row_no, list(r.at), r.xml) for r in found if r.tag == "b") == [(0, [0, 0], '<b i="1">é<b i="2"></b></b>'), (1, [0, 0], "<b></b>"), (2, [0, 1], "<b>x</b>")]
    assert [r.file[-5:] for r in found if r.tag == pull.ERROR] == ["b.xml"]


def test_files_are_written_and_opened_once(spark, tmp_path):
    """logs are whole files in few folders, elements come from a generator."""
    import os

    from waymark.plans import logs
    from waymark.sources import text, xml

    lines = spark.createDataFrame([(f"u {i % 600}", i, f"{1400000 + i}|5000000|Pé{i}|0|") for i in range(1800)], "file string, nth long, line string")
    path = logs.written(lines, "itn")
    assert len(os.listdir(path)) <= 256
    out = text.read_itn(spark, path).routepoints
    assert out.count() == 1800 and out.select("file").distinct().count() == 600
    (tmp_path / "a.loc").write_text('<loc><waypoint><name id="A">x</name><coord lat="50" lon="14"/></waypoint></loc>')
    way = xml.read_loc(spark, str(tmp_path)).waypoints
    assert [(r.name, r.lon) for r in way.collect()] == [("A", 14.0)] and "inline(" in way._jdf.queryExecution().optimizedPlan().toString()
