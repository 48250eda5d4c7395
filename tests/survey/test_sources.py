import io
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathframe.errors import InputError
from swathframe.sources import control, headers, photos
from swathframe.streaming import events


def ifd(fields, base=0, order="<"):
    """A TIFF stream of one directory with sub-directories given as dicts."""
    subs = {t: v for t, v in fields.items() if isinstance(v, dict)}
    size = lambda f: 2 + 12 * len(f) + 4
    out, extra = b"", b""
    places, next_at = {}, base + size(fields)
    for t, v in subs.items():
        body = ifd(v, next_at, order)
        places[t] = (next_at, body)
        next_at += len(body)
    over = next_at
    out += struct.pack(order + "H", len(fields))
    for t in sorted(fields):
        v = fields[t]
        if t in places:
            out += struct.pack(order + "HHII", t, 4, 1, places[t][0])
            continue
        if isinstance(v, str):
            kind, raw, n = 2, v.encode() + b"\0", len(v.encode()) + 1
        elif isinstance(v, bytes):
            kind, raw, n = 1, v, len(v)
        elif isinstance(v, int):
            kind, raw, n = 4, struct.pack(order + "I", v), 1
        else:  # rationals
            kind, n = 5, len(v)
            raw = b"".join(struct.pack(order + "II", round(x * 1000), 1000) for x in v)
        if len(raw) <= 4:
            out += struct.pack(order + "HHI", t, kind, n) + raw.ljust(4, b"\0")
        else:
            out += struct.pack(order + "HHII", t, kind, n, over + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
    return out + b"\0" * 4 + b"".join(b for _, b in places.values()) + extra


def tiff(fields, order="<"):
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + ifd(fields, 8, order)


def jpeg(exif=None, xmp="", width=40, height=30):
    out = b"\xff\xd8"
    if exif:
        out += b"\xff\xe1" + struct.pack(">H", len(exif) + 8) + b"Exif\0\0" + exif
    if xmp:
        body = b"http://ns.adobe.com/xap/1.0/\0" + f"<x:xmpmeta>{xmp}</x:xmpmeta>".encode()
        out += b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body
    return out + b"\xff\xc0" + struct.pack(">HBHHB", 8, 8, height, width, 1) + b"\0" * 10


EXIF = {271: "DJI", 272: "FC1", 34665: {36867: "2024:05:01 10:00:00", 37386: (8.8,), 41989: 24}, 34853: {1: "N", 2: (37.0, 30.0, 36.0), 3: "W", 4: (127.0, 0.0, 0.0), 5: b"\1", 6: (12.5,)}}


@pytest.mark.parametrize("order", ["<", ">"])
def test_shot(order):
    r = photos.shot("a.jpg", jpeg(tiff(EXIF, order)))
    assert (r["width"], r["height"], r["make"], r["datetime"], r["focal_mm"], r["focal_35mm"]) == (40, 30, "DJI", "2024:05:01 10:00:00", 8.8, 24.0)
    assert (r["lat"], r["lon"], r["abs_alt"]) == pytest.approx((37.51, -127.0, -12.5)) and r["camera_key"] == "DJI FC1 | 8.8mm | 40x30"


def test_shot_xmp():
    xmp = '<rdf:Description drone-dji:AbsoluteAltitude="+120.5" drone-dji:GimbalPitchDegree="-90" drone-dji:RtkFlag="50" drone-dji:GpsLatitude="35.5" drone-dji:GpsLongtitude="129.1"><drone-dji:RelativeAltitude>60.1</drone-dji:RelativeAltitude></rdf:Description>'
    r = photos.shot("a.jpg", jpeg(None, xmp))
    assert (r["abs_alt"], r["rel_alt"], r["gimbal_pitch"], r["rtk_flag"], r["lat"], r["lon"]) == (120.5, 60.1, -90.0, 50, 35.5, 129.1)
    assert photos.shot("a.jpg", jpeg(tiff(EXIF), xmp))["abs_alt"] == 120.5


BAND_XMP = '<x:xmpmeta xmlns:x="y"><d Camera:BandName="NIR" Camera:RigCameraIndex="3" Camera:CentralWavelength="840" Camera:PerspectiveFocalLength="5.5" Camera:PerspectiveDistortion="1,2,3,4,5" DLS:HorizontalIrradiance="120"><MicaSense:RadiometricCalibration><rdf:Seq><rdf:li>1e-4</rdf:li><rdf:li>2e-7</rdf:li></rdf:Seq></MicaSense:RadiometricCalibration></d></x:xmpmeta>'


def test_band():
    fields = {256: 1280, 257: 960, 258: 16, 700: BAND_XMP.encode(), 34665: {33434: (0.002,), 34855: 400, 41486: (266.0,), 41487: (266.0,), 41488: 4}}
    r = photos.band("x/IMG_0001_3.tif", tiff(fields))
    assert (r["band"], r["rig_index"], r["capture"], r["gain"], r["exposure"]) == ("NIR", 3, "IMG_0001", 4.0, 0.002)
    assert r["dist"] == [1, 2, 4, 5, 3] and r["irradiance"] == pytest.approx(1.2) and r["radcal"] == [1e-4, 2e-7]
    assert r["fx"] == pytest.approx(5.5 * 266) and r["cx"] == pytest.approx(640.5) and not r["panel"]
    assert photos.band("a.tif", tiff({256: 1, 257: 1})) is None


@pytest.mark.parametrize("kind", [np.uint8, np.uint16, np.float32])
@pytest.mark.parametrize("shape", [(5, 7), (4, 3, 3)])
def test_tiff_round_trip(kind, shape):
    p = (np.arange(np.prod(shape)).reshape(shape) * 257 % 60000).astype(kind)
    data = headers.tiff_bytes(p, 100.0, 200.0, 0.5, 5186)
    assert (headers.tiff_pixels(data) == p).all()
    tags, _ = headers.tiff_tags(data)
    assert tags[33550][:2] == (0.5, 0.5) and tags[33922][3:5] == (100.0, 200.0) and tags[34735][-1] == 5186


def test_scan_folder(spark, tmp_path):
    (tmp_path / "a.JPG").write_bytes(jpeg(tiff(EXIF)))
    (tmp_path / "broken.jpg").write_bytes(b"\xff\xd8nothing")
    (tmp_path / "b_3.tif").write_bytes(tiff({256: 8, 257: 6, 258: 16, 700: BAND_XMP.encode(), 34665: {41486: (266.0,), 41487: (266.0,)}}))
    (tmp_path / "note.txt").write_text("no photo")
    (tmp_path / "p.tiff").write_bytes(headers.tiff_bytes(np.arange(6, dtype=np.uint16).reshape(2, 3) * 20000))
    shots, failed = photos.scan_folder(spark, str(tmp_path))
    assert [(r.file, r.flags) for r in shots.collect()] == [("a.JPG", [])] and [r.file for r in failed.collect()] == ["broken.jpg"]
    assert [r.band for r in photos.scan_bands(spark, str(tmp_path)).collect()] == ["NIR"]
    with pytest.raises(InputError):
        photos.scan_folder(spark, str(tmp_path / "nowhere"))[0].count()


def test_raw_pixels(spark, tmp_path):
    (tmp_path / "p.tiff").write_bytes(headers.tiff_bytes(np.arange(6, dtype=np.uint16).reshape(2, 3) * 13000))
    assert sorted((r.row, r.col, r.raw) for r in photos.raw_pixels(spark, str(tmp_path)).collect()) == [(i, j, (3 * i + j) * 13000.0) for i in range(2) for j in range(3)]


@pytest.mark.parametrize(
    "text,delimiter,guess",
    [
        ("name,east,north,h\nA1,200000.5,\"600,000.1\",12\nA2,200010,600020,13\n", ",", {"name": 0, "x": 1, "y": 2, "z": 3}),
        ("# notes\nP1\t1.0\t2.0\t3.0\nP2\t4\t5\t6\n", "\t", {"name": 0, "x": 1, "y": 2, "z": 3}),
        ("1 100.5 200.5 3\n2 101 201 4\n", "whitespace", {"name": 0, "x": 1, "y": 2, "z": 3}),
        ("점명;경도;위도;표고\nG1;127.1;37.5;30\n", ";", {"name": 0, "x": 1, "y": 2, "z": 3}),
    ],
)
def test_look(text, delimiter, guess):
    for encoding in ("utf-8-sig", "cp949"):
        seen = control.look(text.encode(encoding))
        assert seen.delimiter == delimiter and seen.guess == guess
    with pytest.raises(InputError):
        control.look(b"\n# nothing\n")


def test_load_points(spark, tmp_path):
    f = tmp_path / "gcp.csv"
    f.write_text("name,x,y,z\nA,200000,600000,1\nB,bad,1,1\nC,200010,\"600,010\",2\n")
    rows = control.load_points(spark, str(f), 5186, check=("C",)).collect()
    assert [(r.name, r.x, r.y, r.role) for r in rows] == [("A", 200000.0, 600000.0, "control"), ("C", 200010.0, 600010.0, "check")]
    seen = control.look(f.read_bytes())
    assert control.guess_system(spark, seen, 127.0, 38.0)["epsg"] == 5186
    assert control.guess_system(spark, seen, 10.0, 10.0)["epsg"] is None


def test_serve():
    def count(request, report):
        report.stage("count", "now")
        report.progress(1, request["n"])
        return request["n"]

    out = io.StringIO()
    lines = ['{"job": 1, "command": "count", "n": 4}', "not json", '{"job": 2, "command": "none"}', '{"job": 3, "command": "count"}', "[]"]
    events.serve({"count": count}, io.StringIO("\n".join(lines)), out)
    said = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [(x["job"], x["type"]) for x in said[:4]] == [(1, "stage"), (1, "progress"), (1, "result"), (1, "done")]
    assert [x["code"] for x in said if x["type"] == "error"] == ["invalid_request", "invalid_argument", "internal_error", "invalid_argument"]
    assert sum(x["type"] == "done" for x in said) == 5


def test_cancel():
    token = events.CancelToken()
    report = events.Reporter(cancel=token)
    report.stage("a")
    token.cancel()
    with pytest.raises(Exception, match="cancelled"):
        report.progress(1, 2)
    assert events.Event("progress", current=3, total=2).fraction == 1.0 and events.Event("log").fraction is None


def test_live_coverage(spark, tmp_path):
    rows = spark.createDataFrame([("s", 1, 2, "2024-01-01 10:00:00"), ("s", 1, 2, "2024-01-01 11:00:00"), ("s", 0, 0, "2024-01-05 00:00:00")], "survey string, row int, col int, ts string").selectExpr("survey", "row", "col", "cast(ts as timestamp) ts")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = events.live_coverage(stream).writeStream.outputMode("complete").format("memory").queryName("live").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.row, r.col, r.n) for r in spark.sql("select * from live").collect()} == {(1, 2, 2), (0, 0, 1)}


def test_exports(spark):
    from swathframe.sources import exports

    rows = spark.createDataFrame([(2, 1.5, 2.5, 3.5, 255, 0, 1), (1, 0.5, 0.25, -1.0, 9, 8, 7)], "point_id long, x double, y double, z double, red int, green int, blue int")
    xyz, rgb = exports.ply_points(exports.ply_bytes(rows))
    assert xyz.tolist() == [[0.5, 0.25, -1.0], [1.5, 2.5, 3.5]] and rgb.tolist() == [[9, 8, 7], [255, 0, 1]]
    grid = spark.createDataFrame([(0, 1, 2.5), (1, 0, 3.5)], "row int, col int, z double")
    p = headers.tiff_pixels(exports.grid_tiff(grid, "z", 2, 2, 0.0, 10.0, 1.0, 5186))
    assert p[0, 1] == 2.5 and p[1, 0] == 3.5 and np.isnan(p[0, 0])


def test_outlines():
    from swathframe.sources import exports

    mask = np.array([[1, 1, 0], [1, 1, 0], [0, 0, 1]], bool)
    area = lambda ring: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))) / 2
    rings = exports.outlines(mask, 100.0, 50.0, 2.0)
    assert [area(r) for r in rings] == [16.0, 4.0] and all(r[0] == r[-1] for r in rings) and [len(r) for r in rings] == [5, 5]
    holed = np.ones((5, 5), bool)
    holed[2, 2] = False
    assert [area(r) for r in exports.outlines(holed, 0.0, 0.0, 1.0)] == [25.0]
    bend = np.array([[1, 1, 1], [1, 0, 0], [1, 1, 1]], bool)
    assert [area(r) for r in exports.outlines(bend, 0.0, 0.0, 1.0)] == [7.0]
    assert exports.png_bytes(np.zeros((2, 3), np.uint8))[:4] == b"\x89PNG"


def test_rasters(spark, tmp_path):
    from swathframe.sources import rasters

    p = np.arange(24, dtype=np.float32).reshape(4, 6)
    p[0, 0] = np.nan
    (tmp_path / "dsm.tif").write_bytes(headers.tiff_bytes(p, 100.0, 200.0, 2.0, 5186))
    g = rasters.georeferences(spark, str(tmp_path / "dsm.tif")).first()
    assert (g.west, g.north, g.res, g.rows, g.cols, g.epsg, g.names) == (100.0, 200.0, 2.0, 4, 6, 5186, ["band1"])
    cells, grids = rasters.read_surface(spark, str(tmp_path / "dsm.tif"))
    assert {(r.row, r.col): r.z for r in cells.collect()} == {(i, j): float(p[i, j]) for i in range(4) for j in range(6) if i or j}
    assert (grids.first().x0, grids.first().y0) == (101.0, 199.0)
    part = rasters.read_cells(spark, str(tmp_path / "dsm.tif"), bounds=(103.0, 192.0, 106.0, 196.0)).collect()
    assert sorted((r.row, r.col) for r in part) == [(2, 1), (2, 2), (3, 1), (3, 2)]
    small = {(r.row, r.col): (r.x, r.y, r["values"][0]) for r in rasters.read_cells(spark, str(tmp_path / "dsm.tif"), shrink=2).collect()}
    assert len(small) == 6 and small[0, 0] == pytest.approx((102.0, 198.0, (1 + 6 + 7) / 3)) and small[1, 2] == pytest.approx((110.0, 194.0, p[2:, 4:].mean()))
    rgba = np.arange(16, dtype=np.uint8).reshape(2, 2, 4)
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "ortho.tif").write_bytes(headers.tiff_bytes(rgba, 0.0, 10.0, 1.0, 32652))
    row = rasters.read_cells(spark, str(tmp_path / "o")).filter("row = 1 and col = 0").select(rasters.reordered(F.col("values"), "bgr").alias("v")).first()
    assert row.v == [10.0, 9.0, 8.0]
    with pytest.raises(InputError):
        rasters.reordered(F.col("values"), "gray")
    (tmp_path / "i").mkdir()
    for name, k in (("OWN", 3), ("ndre", 2), ("NDVI", 1)):
        (tmp_path / "i" / f"{name}.tif").write_bytes(headers.tiff_bytes(np.full((2, 2), k, np.float32), 0.0, 2.0, 1.0, 5186))
    assert rasters.index_order(["OWN", "ndre", "NDVI"]) == ["NDVI", "NDRE", "OWN"]
    assert {r.value for r in rasters.read_indices(spark, str(tmp_path / "i"), "ndre").collect()} == {2.0} and rasters.read_indices(spark, str(tmp_path / "i")).count() == 12
    with pytest.raises(InputError):
        rasters.read_indices(spark, str(tmp_path / "i"), "EVI")


def test_notes_of_rasters():
    from swathframe.sources import rasters

    data = bytearray(headers.tiff_bytes(np.zeros((1, 1, 2), np.uint8)))
    assert rasters.georeference(bytes(data))["names"] == ["band1", "band2"] and rasters.georeference(bytes(data))["west"] is None


def test_many_control_files(spark, tmp_path):
    """A folder of files in different readings is one scan."""
    (tmp_path / "a.csv").write_text("pt,east,north,el\nA,1,2,3\n")
    (tmp_path / "b.csv").write_bytes("측점\t위도\t경도\t고도\nB\t37.5\t127.1\t9\n".encode("cp949"))
    (tmp_path / "c.csv").write_text("# no rows\n")
    (tmp_path / "d.csv").write_text("A1 1,000.5 2,000.5 3\nA2 1,001 2,001 4\n")
    rows = control.load_points(spark, str(tmp_path), 5186).collect()
    assert sorted((r.file.rsplit("/", 1)[-1], r.name, r.x, r.y, r.z) for r in rows) == [("a.csv", "A", 1.0, 2.0, 3.0), ("b.csv", "B", 127.1, 37.5, 9.0), ("d.csv", "A1", 1000.5, 2000.5, 3.0), ("d.csv", "A2", 1001.0, 2001.0, 4.0)]
