"""Folders of photos as tables: shots of JPEGs, bands of multispectral TIFFs, pixels.

Files come through Spark's binaryFile source, so a folder may lie in any store; headers are parsed where the files are read, and a
file that can't be read is a row with `error`.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError
from ..operators.scan import flags
from .headers import TAGS, degrees, jpeg_header, number, numbers, tiff_pixels, tiff_tags, xmp_packet, xmp_values

SHOT = (
    "file string, error string, width int, height int, make string, model string, datetime string, focal_mm double, focal_35mm double, lat double, lon double, abs_alt double, rel_alt double, "
    "gimbal_yaw double, gimbal_pitch double, gimbal_roll double, flight_yaw double, rtk_flag int, camera_key string"
)
BAND = (
    "file string, error string, capture string, band string, rig_index int, wavelength double, width int, height int, make string, model string, bits int, black_level double, exposure double, gain double, "
    "radcal array<double>, vig_center array<double>, vig_poly array<double>, vig2d array<double>, vig2d_exp array<double>, fx double, fy double, cx double, cy double, dist array<double>, "
    "rig_rot_deg array<double>, rig_trans_mm array<double>, irradiance double, albedo double, panel_area array<double>, lat double, lon double, alt double, datetime string, cam_ypr array<double>, panel boolean"
)
# Millimetres of a focal plane unit's code.
PLANE_UNITS = {2: 25.4, 3: 10.0, 4: 1.0, 5: 0.001}
PHOTO, TIFF = re.compile(r"\.jpe?g$", re.I), re.compile(r"\.tiff?$", re.I)


def _position(gps: dict) -> tuple[float | None, float | None, float | None]:
    alt = number(gps.get(6))
    if alt is not None and gps.get(5) in (1, b"\x01"):
        alt = -alt
    return degrees(gps.get(2), gps.get(1)), degrees(gps.get(4), gps.get(3)), alt


def _sub(data: bytes, tags: dict, name: str, order: str) -> dict:
    from .headers import directory

    at = tags.get(TAGS[name])
    return directory(data, at, order) if isinstance(at, int) and 0 < at < len(data) else {}


def shot(name: str, data: bytes) -> dict:
    """Record of a JPEG: EXIF first; the maker's XMP overrides the altitude and fills a missing position."""
    width, height, exif = jpeg_header(data)
    tags, ex, gps = {}, {}, {}
    if exif:
        tags, order = tiff_tags(exif)
        ex, gps = _sub(exif, tags, "exif", order), _sub(exif, tags, "gps", order)
    lat, lon, alt = _position(gps)
    dji = {k.split(":")[1]: v for k, v in xmp_values(xmp_packet(data)).items() if k.startswith("drone-dji:")}
    pick = lambda k: number(dji.get(k))
    if lat is None:
        lat, lon = pick("GpsLatitude"), number(dji.get("GpsLongitude") or dji.get("GpsLongtitude"))
    rtk, focal = pick("RtkFlag"), number(ex.get(TAGS["focal"]))
    make, model = tags.get(TAGS["make"]) or None, tags.get(TAGS["model"]) or None
    higher = pick("AbsoluteAltitude")
    return {
        "file": name, "width": width, "height": height, "make": make, "model": model, "datetime": ex.get(TAGS["datetime"]), "focal_mm": focal, "focal_35mm": number(ex.get(TAGS["focal_35mm"])), "lat": lat, "lon": lon,
        "abs_alt": alt if higher is None else higher, "rel_alt": pick("RelativeAltitude"), "gimbal_yaw": pick("GimbalYawDegree"), "gimbal_pitch": pick("GimbalPitchDegree"), "gimbal_roll": pick("GimbalRollDegree"),
        "flight_yaw": pick("FlightYawDegree"), "rtk_flag": None if rtk is None else int(rtk), "camera_key": f"{make or '?'} {model or '?'} | {'?' if focal is None else format(focal, '.1f')}mm | {width}x{height}",
    }


def band(name: str, data: bytes) -> dict | None:
    """Record of a multispectral band's TIFF; None of any other."""
    tags, order = tiff_tags(data)
    raw = tags.get(TAGS["xmp"], b"")
    x = xmp_values(raw.decode("utf-8", "ignore") if isinstance(raw, bytes) else bytes(raw).decode("utf-8", "ignore") if isinstance(raw, tuple) else str(raw))
    if not x.get("Camera:BandName") or "Camera:RigCameraIndex" not in x:
        return None
    ex, gps = _sub(data, tags, "exif", order), _sub(data, tags, "gps", order)
    one = lambda k: (numbers(x.get(k)) or [None])[0]
    width, height = int(tags[TAGS["width"]]), int(tags[TAGS["height"]])
    mm = PLANE_UNITS.get(int(number(ex.get(TAGS["plane_unit"])) or 4), 1.0)
    rx, ry, focal = (number(ex.get(TAGS["plane_x"])) or 0) / mm, (number(ex.get(TAGS["plane_y"])) or 0) / mm, one("Camera:PerspectiveFocalLength")
    if not (rx and ry and focal):
        raise ValueError("no focal length or focal plane resolution")
    centre = numbers(x.get("Camera:PrincipalPoint")) or [width / 2 / rx, height / 2 / ry]
    k1, k2, k3, p1, p2 = ((numbers(x.get("Camera:PerspectiveDistortion")) or []) + [0.0] * 5)[:5]
    light = one("DLS:HorizontalIrradiance") or one("Camera:Irradiance") or one("DLS:SpectralIrradiance")
    unit = one("Camera:IrradianceScaleToSIUnits")
    unit = unit if unit is not None else 0.01 if "DLS:HorizontalIrradiance" in x else 1.0
    black = tags.get(TAGS["black_level"]) or 0
    area = numbers(x.get("Camera:ReflectArea"))
    albedo = one("Camera:Albedo") if one("Camera:CalibrationPicture") == 2 else None
    turn = [one(f"Camera:{k}") for k in ("Yaw", "Pitch", "Roll")]
    lat, lon, alt = _position(gps)
    stem = re.sub(r"\.[^.]*$", "", name.rsplit("/", 1)[-1])
    iso = number(ex.get(TAGS["iso"])) or number(ex.get(TAGS["iso_speed"])) or 100
    return {
        "file": name, "capture": str(x.get("MicaSense:CaptureId") or re.sub(r"_\d+$", "", stem)), "band": str(x["Camera:BandName"]), "rig_index": int(one("Camera:RigCameraIndex") or 0), "wavelength": one("Camera:CentralWavelength"),
        "width": width, "height": height, "make": tags.get(TAGS["make"]) or None, "model": tags.get(TAGS["model"]) or None, "bits": int(number(tags.get(TAGS["bits"])) or 16),
        "black_level": sum(numbers(black) or [0.0]) / len(numbers(black) or [0.0]) if isinstance(black, (tuple, list)) else float(black), "exposure": number(ex.get(TAGS["exposure"])) or 0.0, "gain": iso / 100,
        "radcal": numbers(x.get("MicaSense:RadiometricCalibration")), "vig_center": numbers(x.get("Camera:VignettingCenter")), "vig_poly": numbers(x.get("Camera:VignettingPolynomial")),
        "vig2d": numbers(x.get("Camera:VignettingPolynomial2D")), "vig2d_exp": numbers(x.get("Camera:VignettingPolynomial2DName")), "fx": focal * rx, "fy": focal * ry, "cx": centre[0] * rx + 0.5, "cy": centre[1] * ry + 0.5,
        "dist": [k1, k2, p1, p2, k3], "rig_rot_deg": numbers(x.get("Camera:RigRelatives")), "rig_trans_mm": numbers(x.get("Camera:RigTranslations")), "irradiance": light * unit if light else None, "albedo": albedo,
        "panel_area": area, "lat": lat, "lon": lon, "alt": alt, "datetime": ex.get(TAGS["datetime"]), "cam_ypr": turn if None not in turn else None, "panel": albedo is not None and area is not None,
    }


def _arrow(kind: str) -> pa.DataType:
    return {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}[kind]


def _parser(read, schema: str, root: str):
    names, kinds = zip(*(c.strip().split(" ") for c in schema.split(", ")))

    def parse(batches):
        for b in batches:
            rows = []
            for path, data in zip(b.column("path").to_pylist(), b.column("content")):
                name = path.split(root, 1)[-1].lstrip("/") if root and root in path else path.rsplit("/", 1)[-1]
                try:
                    row = read(name, data.as_py())
                except Exception as e:  # noqa: BLE001  a broken file is a row of its own
                    row = {"file": name, "error": f"{type(e).__name__}: {e}"}
                if row is not None:
                    rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _arrow(k)) for n, k in zip(names, kinds)], list(names))

    return parse


def files(spark: SparkSession, folder: str, pattern: str, recursive: bool = False) -> DataFrame:
    """path and content of a folder's files whose path matches."""
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder if recursive else f"{folder}/*")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise InputError(f"no folder {folder}", "folder_not_found") from e
        raise
    return found.filter(F.lower("path").rlike(pattern)).select("path", "content")


def scan_folder(spark: SparkSession, folder: str, recursive: bool = False, survey: str = "survey") -> tuple[DataFrame, DataFrame]:
    """Shots of a folder's JPEGs (with flags, all selected), and the files that failed (file, error)."""
    root = re.sub(r"^\w+:/*", "", folder).strip("/")
    rows = files(spark, folder, r"\.jpe?g$", recursive).mapInArrow(_parser(shot, SHOT, root), SHOT)
    shots = rows.filter("error is null").drop("error").withColumns({"survey": F.lit(survey), "flags": flags(F.col("lat"), F.col("lon"), F.col("gimbal_pitch")), "selected": F.lit(True)})
    return shots, rows.filter("error is not null").select("file", "error")


def scan_bands(spark: SparkSession, folder: str, recursive: bool = False, survey: str = "survey") -> DataFrame:
    """Bands of a folder's multispectral TIFFs; other and broken files are left out."""
    root = re.sub(r"^\w+:/*", "", folder).strip("/")
    rows = files(spark, folder, r"\.tiff?$", recursive).mapInArrow(_parser(band, BAND, root), BAND)
    return rows.filter("error is null").drop("error").withColumn("survey", F.lit(survey))


def raw_pixels(spark: SparkSession, folder: str, stride: int = 1) -> DataFrame:
    """(file, row, col, raw) of every stride-th sample of a folder's one-channel TIFFs."""

    def read(batches):
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content")):
                p = tiff_pixels(data.as_py())[::stride, ::stride]
                for r in range(len(p)):
                    yield pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[-1]] * p.shape[1]), pa.array([r * stride] * p.shape[1], pa.int32()), pa.array(range(0, p.shape[1] * stride, stride), pa.int32()), pa.array(p[r].astype(float))], ["file", "row", "col", "raw"])

    return files(spark, folder, r"\.tiff?$").mapInArrow(read, "file string, row int, col int, raw double")
