"""Water: votes of views, bodies of cells, their level, masks.

Mask cells are 0 (land), 1 (candidate), 2 (confident).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grids import labels_of

# Share of frames that make a cell a candidate; a body's least cells and area; most density against land; shore
# ring in metres and least points in it; percentile of its level; most rise inside and most drop at the shore; automatic switch.
VOTE, LEAST_CELLS, LEAST_AREA, EMPTY, RING, LEAST_SHORE, LEVEL, RAISED, DROP, AUTO = 0.5, 4, 100.0, 0.15, 4.0, 5, 0.25, 1.5, 3.0, 0.05
MODES = ("auto", "on", "off")


def cell_votes(seen: DataFrame, least: float = VOTE) -> DataFrame:
    """(survey, row, col, looks, share, candidate) of looks (survey, row, col, view, mask)."""
    return seen.groupBy("survey", "row", "col").agg(F.count("*").alias("looks"), F.avg((F.col("mask") > 0).cast("double")).alias("share")).withColumn("candidate", F.col("share") >= least)


def point_density(points: DataFrame, cells: DataFrame) -> DataFrame:
    """cells (survey, row, col, candidate) with `points`, and the mean of land cells in `land`."""
    n = points.groupBy("survey", "row", "col").agg(F.count("*").alias("points"))
    rows = cells.join(n, ["survey", "row", "col"], "left").withColumn("points", F.coalesce("points", F.lit(0)))
    land = rows.groupBy("survey").agg(F.avg(F.when(~F.col("candidate"), F.col("points"))).alias("land"))
    return rows.join(land, "survey")


def label_cells(cells: DataFrame) -> DataFrame:
    """(survey, row, col, label) of candidate cells. A group is one survey's candidates, which a flight bounds."""

    def one(t: pa.Table) -> pa.Table:
        r, c = t.column("row").to_numpy(), t.column("col").to_numpy()
        mask = np.zeros((r.max() - r.min() + 1, c.max() - c.min() + 1), bool)
        mask[r - r.min(), c - c.min()] = True
        return t.append_column("label", pa.array(labels_of(mask)[r - r.min(), c - c.min()].astype(np.int32)))

    kind = cells.schema["survey"].dataType.simpleString()
    return cells.filter("candidate").select("survey", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).groupBy("survey").applyInArrow(one, f"survey {kind}, row int, col int, label int")


def shore(labelled: DataFrame, res: float, ring: float = RING) -> DataFrame:
    """(survey, label, row, col): cells outside any body and within a square ring of one."""
    d = max(1, round(ring / res))
    near = F.explode(F.sequence(F.lit(-d), F.lit(d)))
    around = labelled.withColumn("i", near).withColumn("j", near).select("survey", "label", (F.col("row") + F.col("i")).alias("row"), (F.col("col") + F.col("j")).alias("col")).distinct()
    return around.join(labelled.select("survey", "row", "col"), ["survey", "row", "col"], "left_anti")


def water_bodies(labelled: DataFrame, density: DataFrame, points: DataFrame, res: float) -> DataFrame:
    """(survey, label, cells, level, accepted) of labelled cells, cell densities and points (survey, row, col, z)."""
    place = ["survey", "row", "col"]
    size = labelled.join(density, place).groupBy("survey", "label").agg(F.count("*").alias("cells"), F.avg("points").alias("mean"), F.first("land").alias("land"))
    inside = points.join(labelled, place).groupBy("survey", "label").agg(F.count("*").alias("n_in"), F.median("z").alias("z_in"))
    rim = points.join(shore(labelled, res), place).groupBy("survey", "label").agg(F.count("*").alias("n_shore"), F.percentile("z", F.lit(LEVEL)).alias("level"), F.percentile("z", F.lit(0.05)).alias("p5"), F.median("z").alias("z_shore"))
    rows = size.join(rim, ["survey", "label"], "left").join(inside, ["survey", "label"], "left")
    ok = F.col("cells") >= F.greatest(F.lit(LEAST_CELLS), F.lit(LEAST_AREA / (res * res)))
    ok &= F.col("mean") < EMPTY * F.col("land")
    ok &= F.coalesce(F.col("n_shore") >= LEAST_SHORE, F.lit(False))
    many = F.coalesce("n_in", F.lit(0)) >= F.greatest(F.lit(10.0), 0.2 * F.col("n_shore"))
    ok &= ~many | (F.col("z_in") - F.col("z_shore") <= RAISED)
    ok &= F.col("level") - F.col("p5") <= DROP
    return rows.select("survey", "label", "cells", "level", F.coalesce(ok, F.lit(False)).alias("accepted"))


def summarize(masks: DataFrame) -> DataFrame:
    """Of mask cells (survey, image, v, u, mask): mean water share of images, images with over 1 %, mean confident share."""
    per = masks.groupBy("survey", "image").agg(F.avg((F.col("mask") > 0).cast("double")).alias("f"), F.avg((F.col("mask") == 2).cast("double")).alias("c"))
    return per.groupBy("survey").agg(F.avg("f").alias("fraction"), F.count_if(F.col("f") > 0.01).alias("images_with_water"), F.avg("c").alias("confident_fraction"))


def active(mode: str, fraction: Column) -> Column:
    """Whether masks are used."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    return F.lit(mode == "on") if mode != "auto" else fraction >= AUTO


def normalize_masks(masks: DataFrame) -> DataFrame:
    """Mask values of a whole set read alike: {0, 100, 200} over 100; {0, 1, 2} with a 2 as they are; else all over 0 confident."""
    kind = masks.groupBy("survey").agg(F.collect_set("mask").alias("values"))  # at most 256 values of a byte
    percent = F.size(F.array_except("values", F.array(*map(F.lit, (0, 100, 200))))) == 0
    classes = (F.size(F.array_except("values", F.array(*map(F.lit, (0, 1, 2))))) == 0) & F.array_contains("values", 2)
    value = F.when(percent, F.expr("cast(mask div 100 as int)")).when(classes, F.col("mask")).otherwise(F.when(F.col("mask") > 0, 2).otherwise(0))
    return masks.join(kind, "survey").withColumn("mask", value.cast("int")).drop("values")


def largest_bodies(bodies: DataFrame, most: int = 10) -> DataFrame:
    """The bodies of most cells of each survey, ties by label: a bounded report."""
    return bodies.withColumn("place", F.row_number().over(Window.partitionBy("survey").orderBy(F.desc("cells"), "label"))).filter(F.col("place") <= most)


def masks_of(masks: DataFrame, images: DataFrame) -> DataFrame:
    """Given masks of images (survey, image) that are there."""
    return masks.join(images.select("survey", "image").distinct(), ["survey", "image"], "left_semi")


def mode_of(text: Column) -> Column:
    """A mode as it is written, in any case; none is auto. Null for an unknown one."""
    m = F.lower(F.trim(F.coalesce(text, F.lit("auto"))))
    return F.when(m.isin(*MODES), m)


def decided(mode: Column, fraction: Column) -> Column:
    """Whether water is treated: as the mode says, or by the share of water where one was found."""
    return (mode != "off") & fraction.isNotNull() & ((mode == "on") | (fraction >= AUTO))
