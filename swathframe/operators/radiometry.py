"""Band radiometry: smoothing, panel statistics, reflectance factors, gains of captures."""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share of the full scale from which a pixel counts as saturated.
SATURATED = 0.98
MODES = ("auto", "dls", "dls+panel", "panel", "radiance")
#: Lists of a point's captures (by number) and values, its last mean. Distances that are gathered one by one at most.
STATE, EXACT = "c array<int>, v array<double>, m double", 1 << 16


def smooth_irradiance(series: DataFrame, window: int = 5) -> DataFrame:
    """`smooth`: centred moving median of `irradiance` in the order (datetime, file) of each band; ends are cut short, nulls skipped."""
    half = window // 2
    w = Window.partitionBy("survey", "band").orderBy(F.coalesce("datetime", F.lit("")), "file").rowsBetween(-half, half)
    return series.withColumn("smooth", F.expr("percentile(irradiance, 0.5)").over(w))


def panel_stats(pixels: DataFrame) -> DataFrame:
    """Of each panel image (survey, capture, band): mean radiance, its coefficient of variation, saturated share."""
    r = F.col("radiance")
    out = pixels.groupBy("survey", "capture", "band").agg(F.count("*").alias("pixels"), F.avg(r).alias("mean"), F.stddev_pop(r).alias("std"), F.avg((F.col("raw") >= SATURATED * F.col("full_scale")).cast("double")).alias("saturated"))
    return out.withColumn("cv", F.try_divide("std", "mean")).drop("std")


def choose_mode(bands: DataFrame) -> DataFrame:
    """(survey, mode): the best that every output band allows: dls+panel, dls, panel, radiance."""
    each = bands.groupBy("survey", "band").agg(F.bool_or(F.col("irradiance").isNotNull()).alias("dls"), F.bool_or(F.coalesce("panel", F.lit(False)) & F.col("albedo").isNotNull()).alias("panel"))
    both = each.groupBy("survey").agg(F.bool_and("dls").alias("dls"), F.bool_and("panel").alias("panel"))
    return both.select("survey", F.when(F.col("dls") & F.col("panel"), "dls+panel").when(F.col("dls"), "dls").when(F.col("panel"), "panel").otherwise("radiance").alias("mode"))


def reflectance_factors(flight: DataFrame, panels: DataFrame, modes: DataFrame) -> DataFrame:
    """(survey, capture, band, factor): radiance to reflectance.

    flight: smoothed irradiance of each capture and band. panels: panel images (survey, band, radiance mean, irradiance, albedo).
    modes: survey, mode. dls: pi / irradiance; dls+panel: over the median of measured to stated albedo; panel: the median
    of albedo over radiance; radiance: 1.
    """
    measured = F.try_divide(math.pi * F.col("mean") / F.col("irradiance"), "albedo")
    by = panels.groupBy("survey", "band").agg(F.median(measured).alias("ratio"), F.median(F.try_divide("albedo", "mean")).alias("direct"))
    rows = flight.join(modes, "survey").join(by, ["survey", "band"], "left")
    dls = F.try_divide(F.lit(math.pi), F.col("smooth"))
    factor = F.when(F.col("mode") == "dls", dls).when(F.col("mode") == "dls+panel", F.try_divide(dls, "ratio")).when(F.col("mode") == "panel", F.col("direct")).otherwise(1.0)
    return rows.select("survey", "capture", "band", factor.alias("factor"))


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of points: each row's capture (by number) and value, rows of each point, each point's last mean."""
    sizes = pc.list_value_length(b.column("c")).to_numpy(zero_copy_only=False)
    return *(b.column(k).flatten().to_numpy(zero_copy_only=False) for k in ("c", "v")), sizes, b.column("m").to_numpy(zero_copy_only=False)


def _point_means(c, v, sizes, m, g: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Weight of each row by its distance to its point's last mean, and the points' new means; a point without weight keeps its mean."""
    level = v + g[c]
    z = np.clip((level - np.repeat(m, sizes)) / (4.685 * scale), -1, 1)
    w, at = (1 - z * z) ** 2, np.cumsum(sizes) - sizes
    total = np.add.reduceat(w, at)
    return w, np.divide(np.add.reduceat(w * level, at), total, out=m.copy(), where=total > 0)


def _numbered(batches, captures):
    for b in batches:
        c = pc.index_in(b.column("captures").flatten(), value_set=captures)
        ends = pa.array(np.concatenate([[0], np.cumsum(pc.list_value_length(b.column("captures")).to_numpy(zero_copy_only=False))]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, x) for x in (c, b.column("v").flatten())]
        yield pa.RecordBatch.from_arrays([*lists, pa.array(np.zeros(b.num_rows))], ["c", "v", "m"])


def _moved(batches, g, scale):
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([b.column("c"), b.column("v"), pa.array(_point_means(*_flat(b), g, scale)[1])], ["c", "v", "m"])


def _capture_sums(batches, g, scale):
    up, down = np.zeros(len(g)), np.zeros(len(g))
    for b in batches:
        if b.num_rows:
            c, v, sizes, m = _flat(b)
            w, new = _point_means(c, v, sizes, m, g, scale)
            up += np.bincount(c, w * (np.repeat(new, sizes) - v), len(g))
            down += np.bincount(c, w, len(g))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(g), dtype=np.int32)), pa.array(up), pa.array(down)], ["c", "up", "down"])


def _off_counts(batches, g, shift, held, held_shift):
    """How many rows' distances to their points' means begin with which bits; only of those that begin with held ones, if any."""
    bins, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        if b.num_rows:
            c, v, sizes, m = _flat(b)
            bits = np.abs(v + g[c] - np.repeat(m, sizes)).view(np.int64)  # of numbers from 0 these are in the numbers' order
            if held is not None:
                bits = bits[np.isin(bits >> held_shift, held)]
            new, n = np.unique(bits >> shift, return_counts=True)
            bins, where = np.unique(np.concatenate([bins, new]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, n]), len(bins)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(counts)], ["bin", "n"])


def _median_off(state: DataFrame, g: np.ndarray) -> float:
    """The exact median of the distances: bits are counted from the top, then only below those that hold the middle ranks."""
    shift, held, held_shift, ranks = 40, None, 0, None
    while True:
        t = state.mapInArrow(partial(_off_counts, g=g, shift=shift, held=held, held_shift=held_shift), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow().sort_by("bin")
        bins, ends = t.column("bin").to_numpy(), np.cumsum(t.column("n").to_numpy())
        if ranks is None:
            ranks = np.array([(ends[-1] - 1) // 2, ends[-1] // 2])
        at = np.searchsorted(ends, ranks, side="right")
        if not shift:
            return float(bins[at].view(np.float64).mean())
        before = ends[at[0] - 1] if at[0] else 0
        held, held_shift, ranks = np.unique(bins[at]), shift, ranks - before
        shift = 0 if ends[at[1]] - before <= EXACT else shift - 20


def solve_capture_gains(values: DataFrame, keep, prior: float = 2.0, rounds: int = 25) -> DataFrame:
    """(capture, gain) of log values (point, capture, v): robust, shrunken, centred; points of one row and rows without a value are left out.

    A point's rows are one row of lists, which is shuffled once and moves no more: a round reads the lists and writes them again with
    the points' means. Gains (8 bytes a capture, beside the captures' names) are at the driver and with each task. keep(df) cuts
    lineage (a written table); a kept table needs none but the one before it.
    """
    spark = values.sparkSession
    points = values.filter("v is not null and capture is not null").groupBy("point").agg(F.collect_list(F.struct("capture", F.col("v").cast("double").alias("v"))).alias("rows")).filter("size(rows) >= 2")
    points = keep(points.select(F.col("rows.capture").alias("captures"), F.col("rows.v").alias("v")))
    names = points.select(F.explode("captures").alias("capture")).distinct().toArrow().column("capture").combine_chunks()
    state = keep(points.mapInArrow(partial(_numbered, captures=names), STATE))
    g, scale = np.zeros(len(names)), math.inf  # all weights are 1
    for i in range(rounds if len(names) else 0):
        sums = state.mapInArrow(partial(_capture_sums, g=g, scale=scale), "c int, up double, down double").groupBy("c").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).toArrow().sort_by("c")
        new = sums.column("up").to_numpy() / (sums.column("down").to_numpy() + prior)
        new -= new.mean()
        if i + 1 < rounds:
            state = keep(state.mapInArrow(partial(_moved, g=g, scale=scale), STATE))
            scale = max(0.02, 1.4826 * _median_off(state, new))
        g = new
    out = pa.table({"capture": names, "gain": pa.array(g)})
    return spark.createDataFrame(out, f"capture {values.schema['capture'].dataType.simpleString()}, gain double")


def capture_inconsistency(values: DataFrame, gains: DataFrame) -> DataFrame:
    """RMS deviation from plain point means before and after gains."""
    p = Window.partitionBy("point")
    rows = values.join(gains, "capture", "left").withColumn("a", F.col("v") + F.coalesce("gain", F.lit(0.0))).withColumn("k", F.count("*").over(p)).filter("k >= 2")
    dev = rows.select((F.col("v") - F.avg("v").over(p)).alias("x"), (F.col("a") - F.avg("a").over(p)).alias("y"))
    return dev.agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("before"), F.sqrt(F.avg(F.col("y") * F.col("y"))).alias("after"))


def tukey_weight(d: Column, scale: Column) -> Column:
    z = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), d / (4.685 * scale)))
    return F.pow(1 - z * z, 2)
