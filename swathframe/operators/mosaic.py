"""Mosaics of overlapping views: which views a tile needs, seam weights, blending, tone.

Samples are rows (survey, row, col, view, r, value...), one for every view that sees a pixel; r is the distance from the view's
image centre. All is aggregation by pixel, so that a mosaic of any size is dealt out over its pixels.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights under this are none; gains stay within these limits; cells of a gain map.
CUT, GAIN_LIMIT, GAIN_GRID = 1e-3, math.log(2.0), (48, 64)


def native_gsd(views: DataFrame) -> DataFrame:
    """Median over views (survey, cz, ground_z, fx, fy) of height over focal length."""
    return views.groupBy("survey").agg(F.median(F.greatest(F.col("cz") - F.col("ground_z"), F.lit(1.0)) / ((F.col("fx") + F.col("fy")) / 2.0)).alias("gsd"))


def tiles_of_views(views: DataFrame, tile: float) -> DataFrame:
    """(survey, view, tx, ty): the square tiles that a view's box (x0, y0, x1, y1) overlaps, edges not counted. An equi-join key in place of a theta join."""
    first = lambda c: F.floor(F.col(c) / tile).cast("long")
    last = lambda c: F.ceil(F.col(c) / tile).cast("long") - 1
    span = lambda a, b: F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    return views.withColumn("tx", F.explode(span(first("x0"), last("x1")))).withColumn("ty", F.explode(span(first("y0"), last("y1")))).select("survey", "view", "tx", "ty")


def seam_temperature(gsd: Column, source_gsd: Column, feather_px: float = 6.0) -> Column:
    return F.greatest(feather_px * gsd / source_gsd / 1.5, F.lit(CUT))


def with_seam_weights(samples: DataFrame, temperature: Column, keys=("survey", "row", "col")) -> DataFrame:
    """`w`: exp(-(r - least r of the pixel) / temperature), 0 under CUT."""
    w = F.exp(-(F.col("r") - F.min("r").over(Window.partitionBy(*keys))) / temperature)
    return samples.withColumn("w", F.when(w >= CUT, w).otherwise(0.0))


def blend(weighted: DataFrame, channels: list[str], keys=("survey", "row", "col"), as_bytes: bool = False) -> DataFrame:
    """Weighted means by pixel, alpha 255 where anything has weight; bytes round half up (of nine digits) after clipping."""
    total = F.sum("w")
    mean = lambda c: F.try_divide(F.sum(F.col("w") * F.col(c)), total)
    value = (lambda c: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round(mean(c), 9) + 0.5))).cast("int")) if as_bytes else mean
    return weighted.groupBy(*keys).agg(*(value(c).alias(c) for c in channels), F.when(total > 0, 255).otherwise(0).alias("alpha"))


def blend_bands(weighted: DataFrame, keys=("survey", "row", "col")) -> DataFrame:
    """(keys, band, value) of samples (.., view, band, w, value) under one seam for all bands; pixels lacking a band are left out."""
    bands = weighted.select("survey", "band").distinct().groupBy("survey").agg(F.count("*").alias("bands"))
    each = weighted.groupBy(*keys, "band").agg(F.sum("w").alias("t"), F.try_divide(F.sum(F.col("w") * F.col("value")), F.sum("w")).alias("value")).filter("t > 0")
    whole = each.groupBy(*keys).agg(F.count("*").alias("have")).join(bands, "survey").filter("have = bands").select(*keys)
    return each.join(whole, list(keys), "left_semi").drop("t")


def quicklook_weight(u: Column, v: Column, width: Column, height: Column, power: float = 4.0) -> Column:
    """Weight of a pixel by its nearness to the frame's centre."""
    edge = F.greatest(F.abs(2.0 * u / width - 1.0), F.abs(2.0 * v / height - 1.0))
    return F.pow(F.greatest(F.lit(0.0), 1.0 - edge), F.lit(power))


# ---- tone ----


def log_targets(samples: DataFrame, temperature: Column) -> DataFrame:
    """samples (survey, row, col, view, r, lum) with own = log(lum + 4), w and target (weighted mean of logs in the cell)."""
    own = samples.withColumn("own", F.ln(F.col("lum") + 4.0))
    w = with_seam_weights(own, temperature)
    p = Window.partitionBy("survey", "row", "col")
    return w.withColumn("share", F.try_divide("w", F.sum("w").over(p))).withColumn("target", F.try_divide(F.sum(F.col("w") * F.col("own")).over(p), F.sum("w").over(p)))


def basis(x, y) -> list:
    """Monomials to degree two."""
    one = 1.0 + 0.0 * x
    return [one, x, y, x * x, x * y, y * y]


def robust_fit(a: np.ndarray, b: np.ndarray, w: np.ndarray, rounds: int = 6, least_scale: float = 0.05) -> np.ndarray:
    """Reweighted least squares with a small ridge and Tukey's weights; zeros with fewer than three rows a coefficient."""
    m = a.shape[1]
    if len(b) < 3 * m:
        return np.zeros(m)
    t, x = w.copy(), np.zeros(m)
    for _ in range(rounds):
        x = np.linalg.solve((a * t[:, None]).T @ a + 1e-3 * t.sum() * np.eye(m), (a * t[:, None]).T @ b)
        d = b - a @ x
        s = max(least_scale, 1.4826 * np.median(np.abs(d - np.median(d))))
        t = w * (1 - np.clip(d / (4.685 * s), -1, 1) ** 2) ** 2
        if t.sum() <= 0:
            break
    return x


def fit_gains(targets: DataFrame, most: int = 6000) -> DataFrame:
    """(survey, view, coefficients) of each view's tone surface over its image (nx, ny in [-1, 1]); at most `most` hashed rows a view."""
    rows = targets.withColumn("_rn", F.row_number().over(Window.partitionBy("survey", "view").orderBy(F.xxhash64("row", "col"), "row", "col"))).filter(F.col("_rn") <= most)

    def one(t: pa.Table) -> pa.Table:
        nx, ny, own, target, w, share = (t.column(c).to_numpy() for c in ("nx", "ny", "own", "target", "w", "share"))
        x = robust_fit(np.stack(basis(nx, ny), axis=1), np.clip(target - own, -GAIN_LIMIT, GAIN_LIMIT), w * (1 + 16 * share * (1 - share)))
        return pa.table({"survey": t.column("survey").slice(0, 1), "view": t.column("view").slice(0, 1), "coefficients": pa.array([x.tolist()], pa.list_(pa.float64()))})

    kinds = {f.name: f.dataType.simpleString() for f in targets.schema}
    return rows.filter("w > 0").select("survey", "view", "row", "col", "nx", "ny", "own", "target", "w", "share").groupBy("survey", "view").applyInArrow(one, f"survey {kinds['survey']}, view {kinds['view']}, coefficients array<double>")


def gain_at(coefficients: Column, nx: Column, ny: Column) -> Column:
    s = sum((coefficients[i] * b for i, b in enumerate(basis(nx, ny)) if i), coefficients[0] * 1.0)
    return F.exp(F.greatest(F.lit(-GAIN_LIMIT), F.least(F.lit(GAIN_LIMIT), s)))


def stretch(value: Column, low: Column, high: Column, gamma: float = 1 / 1.6) -> Column:
    """A preview's byte of a value between two percentiles."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(value - low, high - low)))
    return F.floor(F.pow(x, F.lit(gamma)) * 255 + 0.5).cast("int")


def tile_order(tx: Column, ty: Column, block: int = 4) -> Column:
    """Struct by which tiles are drawn: blocks of tiles by rows, and tiles of a block by rows, so that neighbours share their photos."""
    return F.struct(F.floor(ty / block).alias("block_row"), F.floor(tx / block).alias("block_col"), ty.alias("ty"), tx.alias("tx"))


# Bands that a preview shows as red, green and blue, in the order of preference.
PREVIEWS = (("true_color", ("red", "green", "blue")), ("false_color", ("nir", "red", "green")))


def preview_bands(bands: Column) -> Column:
    """Struct kind, indices (from 0) of an array of band names: true colour, else false colour, else the first band thrice."""
    names = F.transform(bands, lambda b: F.lower(F.trim(b)))
    out = F.struct(F.lit("gray").alias("kind"), F.array(F.lit(0), F.lit(0), F.lit(0)).alias("indices"))
    for kind, wanted in reversed(PREVIEWS):
        have = F.size(F.array_intersect(F.array(*map(F.lit, wanted)), names)) == len(wanted)
        out = F.when(have, F.struct(F.lit(kind).alias("kind"), F.array(*((F.array_position(names, w) - 1).cast("int") for w in wanted)).alias("indices"))).otherwise(out)
    return out
