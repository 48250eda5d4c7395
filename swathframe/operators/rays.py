"""Views of posed photos and rays from their pixels: boxes on the ground, what a cell's centre looks like in each photo, where a
pixel's ray meets a surface.

Images are rows (survey, image_id, width, height, lens, r, t): world to camera rotation and shift in map coordinates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.camera import RANGE_FACTOR, border_points, centre, in_image, pixel, ray
from .mosaic import tiles_of_views

#: Points on a side of the frame; pixels at its edge that aren't used; points of a group of rays.
SIDE, MARGIN, GROUP = 9, 0.5, 100_000


def views(images: DataFrame, ground_z: Column, side: int = SIDE) -> DataFrame:
    """images with their centre (cx, cy, cz) and their box on the ground (x0, y0, x1, y1) at a level, no farther than RANGE_FACTOR
    heights; images of fewer than three downward border rays are left out."""
    c = centre(F.col("r"), F.col("t"))
    at = images.withColumns({"cx": c[0], "cy": c[1], "cz": c[2], "ground": ground_z.cast("double")})
    at = at.withColumn("rays", F.transform(border_points(F.col("width").cast("double"), F.col("height").cast("double"), side), lambda b: ray(F.col("lens"), F.col("r"), b["u"], b["v"])))
    at = at.withColumn("rays", F.filter("rays", lambda d: d[2] < -1e-6)).filter(F.size("rays") >= 3)
    reach = F.transform("rays", lambda d: F.struct(((F.col("ground") - F.col("cz")) / d[2] * d[0]).alias("x"), ((F.col("ground") - F.col("cz")) / d[2] * d[1]).alias("y")))
    most = RANGE_FACTOR * F.greatest(F.col("cz") - F.col("ground"), F.lit(1.0))
    at = at.withColumn("reach", reach).withColumn("most", most)
    near = F.transform("reach", lambda q: F.struct((F.col("cx") + q["x"] * F.least(F.lit(1.0), F.col("most") / F.greatest(F.hypot(q["x"], q["y"]), F.lit(1e-9)))).alias("x"), (F.col("cy") + q["y"] * F.least(F.lit(1.0), F.col("most") / F.greatest(F.hypot(q["x"], q["y"]), F.lit(1e-9)))).alias("y")))
    at = at.withColumn("near", near)
    side_of = lambda f, k: f(F.transform("near", lambda q: q[k]))
    return at.withColumns({"x0": side_of(F.array_min, "x"), "y0": side_of(F.array_min, "y"), "x1": side_of(F.array_max, "x"), "y1": side_of(F.array_max, "y")}).drop("rays", "reach", "near", "most", "ground")


def looks(cells: DataFrame, seen: DataFrame, tile: float) -> DataFrame:
    """(survey, row, col, view, u, v, r) of every cell (survey, row, col, x, y, z) and view (of views()) that shows it: its pixel, and
    the pixel's distance from the image centre. Cells and views meet by tiles of the ground."""
    of = seen.withColumn("view", F.col("image_id"))
    met = tiles_of_views(of, tile).join(of.select("survey", "view", "width", "height", "lens", "r", "t"), ["survey", "view"])
    place = lambda c: F.floor(F.col(c) / tile).cast("long")
    both = cells.withColumns({"tx": place("x"), "ty": place("y")}).join(met, ["survey", "tx", "ty"])
    at = F.array(pixel(F.col("lens"), F.col("r"), F.col("t"), F.col("x"), F.col("y"), F.col("z")))
    shown = F.filter(at, lambda p: in_image(p["u"], p["v"], F.col("width"), F.col("height"), MARGIN))
    both = both.select("survey", "row", "col", "view", "width", "height", F.inline(shown))
    return both.select("survey", "row", "col", "view", "u", "v", F.hypot(F.col("u") - F.col("width") / 2.0, F.col("v") - F.col("height") / 2.0).alias("r"), "width", "height")


def sampled(seen: DataFrame, photos: DataFrame, channels: list[str]) -> DataFrame:
    """looks (survey, view, u, v, width, height) with the channels of their photo there: bilinear between pixel centres, the nearest
    one beyond the border. photos: survey, view, prow, pcol and channels of a photo of any size, rows: rows, cols: its size."""
    size = photos.groupBy("survey", "view").agg((F.max("prow") + 1).alias("rows"), (F.max("pcol") + 1).alias("cols"))
    at = seen.join(size, ["survey", "view"])
    clamp = lambda x, n: F.greatest(F.lit(0.0), F.least(n - 1.0, x))
    at = at.withColumns({"fx": clamp(F.col("u") * F.col("cols") / F.col("width") - 0.5, F.col("cols")), "fy": clamp(F.col("v") * F.col("rows") / F.col("height") - 0.5, F.col("rows"))})
    corner = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1))))
    part = lambda f, o: F.when(o == 1, f - F.floor(f)).otherwise(1 - (f - F.floor(f)))
    four = at.withColumn("o", corner).withColumn("share", part(F.col("fy"), F.col("o.i")) * part(F.col("fx"), F.col("o.j"))).filter("share > 0")
    four = four.withColumns({"prow": (F.floor("fy") + F.col("o.i")).cast("int"), "pcol": (F.floor("fx") + F.col("o.j")).cast("int")})
    got = four.join(photos.select("survey", "view", F.col("prow").cast("int").alias("prow"), F.col("pcol").cast("int").alias("pcol"), *channels), ["survey", "view", "prow", "pcol"])
    keys = [c for c in seen.columns if c not in ("u", "v", "width", "height")]
    return got.groupBy(*keys).agg(*(F.sum(F.col("share") * F.col(c)).alias(c) for c in channels))


def bilinear(z: np.ndarray, x0: float, y0: float, res: float, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Heights of a grid (first cell's centre x0, y0, rows downward) at points, clamped at its edges."""
    rows, cols = z.shape
    fx, fy = np.clip((x - x0) / res, 0, cols - 1), np.clip((y0 - y) / res, 0, rows - 1)
    c, r = np.minimum(fx.astype(int), max(cols - 2, 0)), np.minimum(fy.astype(int), max(rows - 2, 0))
    c1, r1 = np.minimum(c + 1, cols - 1), np.minimum(r + 1, rows - 1)
    a, b = fx - c, fy - r
    return (1 - b) * ((1 - a) * z[r, c] + a * z[r, c1]) + b * ((1 - a) * z[r1, c] + a * z[r1, c1])


def meet(origin: np.ndarray, direction: np.ndarray, sample, start: float, rounds: int, tolerance: float, damped: bool) -> np.ndarray:
    """Where rays meet a surface: the level of each goes to the height under it (halfway, if damped) until they agree within the
    tolerance, each ray for itself. Rays that do not point down meet nothing (NaN)."""
    down = direction[:, 2] < -1e-9
    o, d = origin[down], direction[down]
    level, moving = np.full(len(d), float(start)), np.arange(len(d))
    for _ in range(rounds):
        if not len(moving):
            break
        p = o[moving] + ((level[moving] - o[moving, 2]) / d[moving, 2])[:, None] * d[moving]
        under = sample(p[:, 0], p[:, 1])
        near = np.abs(under - level[moving]) < tolerance
        level[moving] = np.where(near | (not damped), under, 0.5 * (level[moving] + under))
        moving = moving[~near]
    out = np.full((len(direction), 3), np.nan)
    out[down] = o + ((level - o[:, 2]) / d[:, 2])[:, None] * d
    return out


def on_surface(rays: DataFrame, cells: DataFrame, grids: DataFrame, rounds: int = 30, tolerance: float = 0.005, damped: bool = True, start: str | None = None) -> DataFrame:
    """rays (survey, ray_id, ox, oy, oz, dx, dy, dz) with x, y, z where they meet their survey's surface (cells: survey, row, col, z;
    grids: survey, x0, y0, res, rows, cols); null where they don't point down. Levels start at the column `start` of grids or at the
    surface's median.

    A survey's rays are dealt out in groups of bounded size, each beside a copy of the survey's grid, which a flight bounds.
    """
    kind, ids = rays.schema["survey"].dataType.simpleString(), rays.schema["ray_id"].dataType.simpleString()
    schema = f"survey {kind}, ray_id {ids}, x double, y double, z double"
    parts = rays.groupBy("survey").agg(F.expr(f"cast(ceil(count(*) / {GROUP}) as int)").alias("parts"))
    left = rays.join(parts, "survey").withColumn("part", F.pmod(F.xxhash64("ray_id"), F.col("parts")).cast("int")).drop("parts")
    georef = grids.join(parts, "survey").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    lead = F.col(start).cast("double") if start else F.lit(None).cast("double")
    right = cells.join(georef.withColumn("start", lead).select("survey", "q", "x0", "y0", "res", "rows", "cols", "start"), "survey").select(F.col("survey").alias("s"), "q", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("z").cast("double").alias("height"), "x0", "y0", "res", "rows", "cols", "start")

    def found(a: pa.Table, b: pa.Table) -> pa.Table:
        xyz = np.full((a.num_rows, 3), np.nan)
        if a.num_rows and b.num_rows:
            x0, y0, res, rows, cols, begin = (b.column(c)[0].as_py() for c in ("x0", "y0", "res", "rows", "cols", "start"))
            z = np.zeros((rows, cols))
            z[b.column("row").to_numpy(), b.column("col").to_numpy()] = b.column("height").to_numpy()
            o, d = (np.stack([a.column(f"{k}{c}").to_numpy() for c in "xyz"], axis=1) for k in "od")
            xyz = meet(o, d, lambda x, y: bilinear(z, x0, y0, res, x, y), np.median(z) if begin is None else begin, rounds, tolerance, damped)
        return pa.table({"survey": a.column("survey"), "ray_id": a.column("ray_id"), **{c: pa.array(xyz[:, i], from_pandas=True) for i, c in enumerate("xyz")}})

    return left.groupBy("survey", "part").cogroup(right.groupBy("s", "q")).applyInArrow(found, schema)
