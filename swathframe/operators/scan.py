"""What a scan of shots yields: flags, cameras, the choice of mapping cameras, summaries, multispectral captures.

Shots are rows (survey, file, make, model, camera_key, focal_mm, focal_35mm, lat, lon, gimbal_pitch, rtk_flag, selected, ...).
`survey` parts independent surveys; every operator works on any number of them at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import suffix

#: A camera tilted up more than this many degrees counts as oblique.
OBLIQUE = -70.0
# Camera models with a rolling shutter.
ROLLING_SHUTTER = ("L1D-20C", "FC2204")
NOT_WIDE = "another camera of the same model is wider"


def flags(lat: Column, lon: Column, pitch: Column) -> Column:
    """Array of no_gps, oblique."""
    return F.array_compact(F.array(F.when(lat.isNull() | lon.isNull(), F.lit("no_gps")), F.when(pitch > OBLIQUE, F.lit("oblique"))))


def with_flags(shots: DataFrame) -> DataFrame:
    return shots.withColumn("flags", flags(F.col("lat"), F.col("lon"), F.col("gimbal_pitch")))


def camera_groups(shots: DataFrame) -> DataFrame:
    """One row a camera: attributes of its first file, number of shots."""
    first = lambda c: F.min_by(c, "file").alias(c)
    return shots.groupBy("survey", "camera_key").agg(first("make"), first("model"), first("focal_mm"), first("focal_35mm"), first("width"), first("height"), F.count("*").alias("count"))


def select_mapping_cameras(shots: DataFrame) -> DataFrame:
    """Of each make and model with several cameras one is kept: files with suffix W first, then the shortest focal length, then
    the first file. Rows (survey, camera_key, kept, reason)."""
    focal = F.coalesce(F.when(F.col("focal_35mm") != 0, F.col("focal_35mm")), F.when(F.col("focal_mm") != 0, F.col("focal_mm")))
    cameras = shots.groupBy("survey", "make", "model", "camera_key").agg(
        F.min(F.when(suffix(F.col("file")) == "W", 0).otherwise(1)).alias("rank"), F.coalesce(F.min(focal), F.lit(float("inf"))).alias("focal"), F.min("file").alias("first")
    )
    order = Window.partitionBy("survey", "make", "model").orderBy("rank", "focal", "first", "camera_key")
    ranked = cameras.withColumn("kept", F.row_number().over(order) == 1)
    return ranked.select("survey", "camera_key", "kept", F.when(~F.col("kept"), F.lit(NOT_WIDE)).alias("reason"))


def with_selection(shots: DataFrame) -> DataFrame:
    """shots with `selected` off for cameras that are not kept."""
    kept = select_mapping_cameras(shots).filter("kept").select("survey", "camera_key", F.lit(True).alias("kept_key"))
    joined = shots.join(kept, ["survey", "camera_key"], "left")
    return joined.withColumn("selected", F.col("selected") & F.col("kept_key").isNotNull()).drop("kept_key")


def scan_summary(shots: DataFrame) -> DataFrame:
    """Counts of each survey over its selected shots."""
    on = F.col("selected")
    return shots.groupBy("survey").agg(
        F.count("*").alias("total_files"),
        F.count_if(on).alias("selected"),
        F.count_if(on & F.array_contains("flags", "no_gps")).alias("no_gps"),
        F.count_if(on & F.array_contains("flags", "oblique")).alias("oblique"),
        F.count_if(on & (F.col("rtk_flag") == 50)).alias("rtk_fixed"),
        F.coalesce(F.bool_or(on & F.upper(F.coalesce("model", F.lit(""))).isin(*ROLLING_SHUTTER)), F.lit(False)).alias("rolling_shutter_warning"),
    )


def positions(shots: DataFrame, selected_only: bool = True) -> DataFrame:
    """file, lon, lat, alt (absolute, else relative, else 0); NaN where unknown."""
    rows = shots.filter("selected") if selected_only else shots
    nan = F.lit(float("nan"))
    return rows.select("survey", "file", F.coalesce("lon", nan).alias("lon"), F.coalesce("lat", nan).alias("lat"), F.coalesce("abs_alt", "rel_alt", F.lit(0.0)).alias("alt"))


# ---- multispectral captures ----


def capture_signatures(bands: DataFrame) -> DataFrame:
    """(survey, capture, signature): the sorted band numbers of each capture."""
    return bands.groupBy("survey", "capture").agg(F.array_sort(F.collect_set("rig_index")).alias("signature"))


def classify_captures(bands: DataFrame) -> DataFrame:
    """(survey, capture, panel, complete): a capture is complete if it has every band of the commonest signature (ties: the first capture's)."""
    seen = capture_signatures(bands)
    counted = seen.groupBy("survey", "signature").agg(F.count("*").alias("n"), F.min("capture").alias("first"))
    full = counted.withColumn("rn", F.row_number().over(Window.partitionBy("survey").orderBy(F.desc("n"), "first"))).filter("rn = 1").select("survey", F.col("signature").alias("full"))
    panel = bands.groupBy("survey", "capture").agg(F.bool_or(F.coalesce("panel", F.lit(False))).alias("panel"))
    return seen.join(full, "survey").join(panel, ["survey", "capture"]).select("survey", "capture", "panel", (F.size(F.array_except("full", "signature")) == 0).alias("complete"))


def reference_bands(bands: DataFrame) -> DataFrame:
    """(survey, rig_index) of the reference: the panchromatic band, else that nearest 560 nm."""
    distance = F.when(F.lower("band") == "panchro", F.lit(-1.0)).otherwise(F.abs(F.coalesce("wavelength", F.lit(0.0)) - 560.0))
    return bands.groupBy("survey").agg(F.min_by("rig_index", F.struct(distance, F.col("rig_index"))).alias("reference"))


def flight_captures(bands: DataFrame) -> DataFrame:
    """Captures that are neither of a panel nor incomplete."""
    return classify_captures(bands).filter("complete and not panel").select("survey", "capture")


def reference_files(bands: DataFrame) -> DataFrame:
    """(survey, file, capture): the file of each capture's reference band; captures that lack it are left out."""
    chosen = reference_bands(bands).withColumnRenamed("reference", "rig_index")
    return bands.join(chosen, ["survey", "rig_index"]).groupBy("survey", "capture").agg(F.min("file").alias("file")).select("survey", "file", "capture")


def positioned_captures(bands: DataFrame, positions: DataFrame) -> DataFrame:
    """Flight captures whose reference file has a position (survey, file, lat, lon)."""
    placed = positions.filter("lat is not null and lon is not null").select("survey", "file")
    return flight_captures(bands).join(reference_files(bands).join(placed, ["survey", "file"], "left_semi"), ["survey", "capture"]).select("survey", "capture", "file")


def output_bands(bands: DataFrame) -> DataFrame:
    """(survey, rig_index, wavelength, place): bands of the commonest signature in the order of wavelength (unknown first), without the panchromatic and thermal ones."""
    full = classify_captures(bands).filter("complete").select("survey", "capture")
    of = bands.join(full, ["survey", "capture"], "left_semi").filter("lower(band) not in ('panchro', 'lwir')").groupBy("survey", "rig_index").agg(F.min("wavelength").alias("wavelength"))
    return of.withColumn("place", F.row_number().over(Window.partitionBy("survey").orderBy(F.coalesce("wavelength", F.lit(0.0)), "rig_index")))


def every_nth(rows: DataFrame, order: str, most: int = 10) -> DataFrame:
    """At most `most` rows of each survey, spread evenly over the order."""
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("survey").orderBy(order)) - 1)
    size = rows.groupBy("survey").agg(F.greatest(F.lit(1), F.floor(F.count("*") / most).cast("int")).alias("step"))
    return placed.join(size, "survey").filter((F.col("place") % F.col("step") == 0) & (F.col("place") / F.col("step") < most)).drop("place", "step")
