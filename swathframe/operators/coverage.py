"""Poses, footprints and coverage of surveys.

Poses follow the order of shots in a survey; footprints are ground polygons of the frame's border; coverage counts footprints
in square cells. Counting joins nothing: a footprint emits the ends of the spans of cells whose centre it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.camera import LEAST_DOWN, RANGE_FACTOR, border_points, camera_axes, focal_px, ground_point
from ..functions.scalars import wrap_angle

LEAST_HEIGHT, ASSUMED_HEIGHT, LOW_OVERLAP = 5.0, 50.0, 2


def _order():
    return Window.partitionBy("survey").orderBy(F.coalesce("datetime", F.lit("")), "file")


def track_yaw(positions: DataFrame) -> DataFrame:
    """`track`: heading from the previous to the next position (ends: to or from themselves), 0 without motion."""
    w = _order()
    step = lambda c: F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c))
    return positions.withColumns({"de": step("e"), "dn": step("n")}).withColumn("track", F.when((F.col("de") == 0) & (F.col("dn") == 0), 0.0).otherwise(F.degrees(F.atan2("de", "dn")))).drop("de", "dn")


def gimbal_offset(shots: DataFrame, least: float = 5.0, spread: float = 5.0) -> DataFrame:
    """(survey, yaw_offset): the median of gimbal less flight yaw, if three shots have both, it is large, and the quartiles are close."""
    d = shots.filter("gimbal_yaw is not null and flight_yaw is not null").select("survey", wrap_angle(F.col("gimbal_yaw") - F.col("flight_yaw")).alias("d"))
    middle = d.groupBy("survey").agg(F.median("d").alias("m"), F.count("*").alias("k"))
    around = d.join(middle, "survey").withColumn("r", wrap_angle(F.col("d") - F.col("m")))
    out = around.groupBy("survey").agg(F.first("m").alias("m"), F.first("k").alias("k"), (F.percentile("r", F.lit(0.75)) - F.percentile("r", F.lit(0.25))).alias("iqr"))
    return out.select("survey", F.when((F.col("k") >= 3) & (F.abs("m") >= least) & (F.col("iqr") <= spread), F.col("m")).alias("yaw_offset"))


def build_poses(shots: DataFrame) -> DataFrame:
    """shots (with projected e, n) to poses: height, yaw, pitch, focal length, and what of these was assumed."""
    whole = Window.partitionBy("survey")
    rel = F.min(F.when(F.col("rel_alt").isNull(), 0).otherwise(1)).over(whole) == 1
    alt = F.coalesce("abs_alt", F.lit(0.0))
    height = F.when(rel, F.col("rel_alt")).otherwise(alt - F.min(alt).over(whole) + ASSUMED_HEIGHT)
    rows = track_yaw(shots).withColumn("over", height).withColumns({"h": F.greatest(F.lit(LEAST_HEIGHT), F.col("over")), "rel": rel}).join(gimbal_offset(shots), "survey", "left")
    yaw = F.col("gimbal_yaw") - F.coalesce("yaw_offset", F.lit(0.0))
    return rows.select(
        "survey", "file", "datetime", "e", "n", "h", F.coalesce(yaw, F.col("track")).alias("yaw"), F.coalesce("gimbal_pitch", F.lit(-90.0)).alias("pitch"), "width", "height",
        focal_px(F.col("focal_35mm"), F.col("width"), F.col("height")).alias("focal"), F.col("gimbal_yaw").isNull().alias("yaw_assumed"), F.coalesce(F.col("focal_35mm") <= 0, F.lit(True)).alias("focal_assumed"),
        (~F.col("rel")).alias("height_assumed"), (F.col("over") < LEAST_HEIGHT).alias("low"), "yaw_offset",
    )


def footprint_vertices(poses: DataFrame, samples: int = 5) -> DataFrame:
    """(survey, file, i, x, y): ground points of the frame's border."""
    p = poses.withColumn("b", F.explode(border_points(F.col("width"), F.col("height"), samples)))
    x, y = ground_point(*(F.col(c) for c in ("e", "n", "h", "yaw", "pitch", "focal", "width", "height")), F.col("b.u"), F.col("b.v"))
    return p.select("survey", "file", F.col("b.i").alias("i"), x.alias("x"), y.alias("y"))


def footprints(poses: DataFrame, samples: int = 5) -> DataFrame:
    """(survey, file, polygon, box): polygon is an array of (x, y).

    A pose is few bytes and much work, here and in what counts footprints, so poses are dealt out over all partitions first.
    """

    # in steps, so that each vertex computes its direction and reach once
    c = F.col
    spread = int(poses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = poses.repartition(spread, "survey", "file").withColumn("axes", camera_axes(c("yaw"), c("pitch")))
    fx, fy = (lambda b: (b["u"] - c("width") / 2.0) / c("focal")), (lambda b: (b["v"] - c("height") / 2.0) / c("focal"))
    along = lambda b, i: fx(b) * c("axes.x")[i] + fy(b) * c("axes.y")[i] + c("axes.z")[i]
    p = p.withColumn("ways", F.transform(border_points(c("width"), c("height"), samples), lambda b: F.struct(along(b, 0).alias("x"), along(b, 1).alias("y"), F.least(along(b, 2), F.lit(-LEAST_DOWN)).alias("z"))))
    p = p.withColumn("reach", F.transform("ways", lambda d: F.struct((c("h") / -d["z"] * d["x"]).alias("x"), (c("h") / -d["z"] * d["y"]).alias("y"))))
    p = p.withColumn("reach", F.transform("reach", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"), F.least(F.lit(1.0), RANGE_FACTOR * c("h") / F.greatest(F.hypot(q["x"], q["y"]), F.lit(1e-12))).alias("k"))))
    p = p.withColumn("polygon", F.transform("reach", lambda q: F.struct((c("e") + q["x"] * q["k"]).alias("x"), (c("n") + q["y"] * q["k"]).alias("y"))))
    side = lambda f, c: f(F.transform("polygon", lambda q: q[c]))
    return p.select("survey", "file", "datetime", "polygon", side(F.array_min, "x").alias("x0"), side(F.array_min, "y").alias("y0"), side(F.array_max, "x").alias("x1"), side(F.array_max, "y").alias("y1"))


def survey_bounds(prints: DataFrame, max_size: int = 2048) -> DataFrame:
    """(survey, xmin, ymin, xmax, ymax, cell): bounds of all footprints, cells of the longer side over max_size."""
    b = prints.groupBy("survey").agg(F.min("x0").alias("xmin"), F.min("y0").alias("ymin"), F.max("x1").alias("xmax"), F.max("y1").alias("ymax"))
    return b.withColumn("cell", F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")) / max_size)


def crossings(polygon: Column, y: Column) -> Column:
    """Where a horizontal line crosses a polygon (closed by its first vertex), from left to right: an even number of places."""
    n = F.size(polygon)

    def place(i):
        a, b = F.element_at(polygon, i), F.element_at(polygon, F.pmod(i, n) + 1)
        return F.when((a["y"] > y) != (b["y"] > y), (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])

    return F.array_sort(F.array_compact(F.transform(F.sequence(F.lit(1), n), place)))


def span(first: Column, last: Column) -> Column:
    """Whole numbers from first to last; none if last is smaller."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def coverage_grid(prints: DataFrame, bounds: DataFrame, exact: bool = True, few: bool = False) -> DataFrame:
    """(survey, row, col, n): footprints that hold each cell's centre; rows count down from ymax. exact=False counts boxes."""
    spans = coverage_spans(prints, bounds, exact, few)
    return spans.select("survey", "row", F.explode(F.sequence(F.col("col"), F.col("after") - 1)).alias("col"), "n")


def coverage_spans(prints: DataFrame, bounds: DataFrame, exact: bool = True, few: bool = False) -> DataFrame:
    """(survey, row, col, after, n): coverage_grid by spans of cells with the same count, from col up to before `after`.

    A survey's bounds are one row (few: known to be so few surveys that they fit a broadcast). A footprint emits, for each row of its
    box, the two ends of each span between the row's crossings with it, so that work grows with outlines and not with areas; running
    sums along a row turn ends into counts.
    """
    f = prints.join(F.broadcast(bounds) if few else bounds, "survey")
    lo = lambda edge: F.greatest(F.lit(0), F.ceil(edge / F.col("cell") - 0.5).cast("int"))
    hi = lambda edge: F.floor(edge / F.col("cell") - 0.5).cast("int")
    rows = f.withColumn("row", F.explode(span(lo(F.col("ymax") - F.col("y1")), hi(F.col("ymax") - F.col("y0")))))
    ends = lambda a, b: F.struct(a.alias("first"), (b + 1).alias("after"))
    if exact:
        at = rows.withColumn("xs", crossings(F.col("polygon"), F.col("ymax") - (F.col("row") + 0.5) * F.col("cell"))).filter(F.size("xs") >= 2)
        side = lambda i: F.ceil((F.col("xs")[i] - F.col("xmin")) / F.col("cell") - 0.5).cast("int")
        spans = F.transform(F.sequence(F.lit(0), (F.size("xs") / 2).cast("int") - 1), lambda k: ends(F.greatest(F.lit(0), side(2 * k)), side(2 * k + 1) - 1))
        spans = at.select("survey", "row", F.inline(spans))
    else:
        spans = rows.select("survey", "row", F.inline(F.array(ends(lo(F.col("x0") - F.col("xmin")), hi(F.col("x1") - F.col("xmin"))))))
    # each end of a span changes the count; rows are dealt out once, for the sums at a place and for the running sums
    change = lambda c, d: F.struct(F.col(c).alias("col"), F.lit(d).alias("d"))
    changes = spans.filter("after > first").select("survey", "row", F.inline(F.array(change("first", 1), change("after", -1)))).repartition("survey", "row")
    line = Window.partitionBy("survey", "row").orderBy("col")
    runs = changes.groupBy("survey", "row", "col").agg(F.sum("d").alias("d")).select("survey", "row", F.col("col").alias("first"), F.sum("d").over(line).alias("n"), F.lead("col").over(line).alias("after"))
    return runs.filter("n > 0").select("survey", "row", F.col("first").alias("col"), "after", "n")


def coverage_stats(area: DataFrame, least: int = LOW_OVERLAP) -> DataFrame:
    """Statistics of the cells of a survey's area (survey, n, interior, cell; cells: how many a row stands for, else one): areas in
    square metres, overlap with empty cells counted."""
    sq = F.first("cell") * F.first("cell")
    cells = F.col("cells") if "cells" in area.columns else F.lit(1)
    total = lambda which: F.coalesce(F.sum(F.when(which, cells)), F.lit(0)) * sq
    return area.groupBy("survey").agg(
        (F.sum(cells) * sq).alias("survey_area_m2"),
        total(F.col("gap") if "gap" in area.columns else F.col("n") == 0).alias("gap_area_m2"),
        total(F.col("interior") & (F.col("n") > 0) & (F.col("n") < least)).alias("low_overlap_area_m2"),
        F.percentile("n", F.lit(0.5), cells).alias("overlap_median"),
        F.percentile("n", F.lit(0.1), cells).alias("overlap_p10"),
    )


# Colours of coverage counts (1; 2; 3 and 4; 5 and more; gap), red, green, blue; alpha of all.
COVERAGE_COLORS, COVERAGE_ALPHA = {"one": (220, 50, 47), "two": (240, 140, 30), "few": (230, 200, 40), "many": (60, 170, 90), "gap": (140, 60, 200)}, 170


def coverage_color(n: Column, gap: Column) -> Column:
    """Array of red, green, blue, alpha."""
    rgba = lambda k: F.array(*(F.lit(v) for v in (*COVERAGE_COLORS[k], COVERAGE_ALPHA)))
    return F.when(gap, rgba("gap")).when(n >= 5, rgba("many")).when(n >= 3, rgba("few")).when(n == 2, rgba("two")).when(n == 1, rgba("one")).otherwise(F.array(*[F.lit(0)] * 4))


def clipped_area(subject, clip) -> float:
    """Area of the part of a polygon inside a convex polygon (both arrays of (x, y))."""
    area = lambda p: 0.5 * sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1]))
    clip = clip if area(clip) > 0 else clip[::-1]
    for (ax, ay), (bx, by) in zip(clip, clip[1:] + clip[:1]):
        side = lambda q: (bx - ax) * (q[1] - ay) - (by - ay) * (q[0] - ax)  # noqa: B023, E731
        out = []
        for p, q in zip(subject, subject[1:] + subject[:1]):
            s, t = side(p), side(q)
            if s >= 0:
                out.append(p)
            if s * t < 0:
                k = s / (s - t)
                out.append((p[0] + k * (q[0] - p[0]), p[1] + k * (q[1] - p[1])))
        subject = out
        if not subject:
            return 0.0
    return abs(area(subject))


def forward_overlap(prints: DataFrame) -> DataFrame:
    """(survey, file, overlap): share of each footprint that the next one covers; footprints without area are left out."""

    def shares(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for p, q in zip(b.column("polygon").to_pylist(), b.column("next").to_pylist()):
                p, q = [(v["x"], v["y"]) for v in p], [(v["x"], v["y"]) for v in q]
                whole = clipped_area(p, p)
                out.append(clipped_area(p, q) / whole if whole > 0 else None)
            yield pa.RecordBatch.from_arrays([b.column("survey"), b.column("file"), pa.array(out, pa.float64())], ["survey", "file", "overlap"])

    rows = prints.withColumn("next", F.lead("polygon").over(_order())).filter("next is not null").select("survey", "file", "polygon", "next")
    kind = prints.schema["survey"].dataType.simpleString()
    return rows.mapInArrow(shares, f"survey {kind}, file string, overlap double").filter("overlap is not null")


def warnings(poses: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """(survey, warnings): what was assumed or corrected, and gaps (survey, n, area_m2) if given, each text once and in order."""
    said = poses.groupBy("survey").agg(
        F.bool_or("height_assumed").alias("assumed"), F.bool_or("low").alias("low"), F.max("yaw_offset").alias("offset"), F.count_if("yaw_assumed").alias("yaws"), F.count_if("focal_assumed").alias("focals")
    )
    said = said.join(gaps.select("survey", F.col("n").alias("gaps"), "area_m2"), "survey", "left") if gaps is not None else said.withColumns({"gaps": F.lit(0), "area_m2": F.lit(0.0)})
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    parts = [
        F.when(F.col("assumed"), F.lit("no relative heights: flying height assumed, footprints may be off in size")),
        F.when(F.col("low"), F.lit("heights under 5 m: footprints may be off")),
        F.when(F.col("offset").isNotNull(), text("gimbal yaw corrected by ", F.round("offset").cast("int"), " degrees")),
        F.when(F.col("yaws") > 0, text("yaw from the track: ", F.col("yaws"))),
        F.when(F.col("focals") > 0, text("focal length assumed: ", F.col("focals"))),
        F.when(F.col("gaps") > 0, text("gaps: ", F.col("gaps"), " of ", F.round("area_m2").cast("long"), " square metres")),
    ]
    return said.select("survey", F.array_distinct(F.array_compact(F.array(*parts))).alias("warnings"))
