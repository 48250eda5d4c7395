"""Georeferencing and adjustment of reconstructions.

Sums over observations are distributed; the solves are of the size of a camera's parameters or a similarity's and run on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import AlignmentError
from .observations import mean_covariance

#: Robust alignment: largest distance of an inlier in metres, draws, seed, least pairs.
RANSAC_METRES, DRAWS, SEED, LEAST_PAIRS = 10.0, 400, 7, 3


def similarity(m: dict) -> tuple[float, np.ndarray, np.ndarray]:
    """Scale, rotation and translation of least squares from one row of mean_covariance()."""
    s, t = ("sx", "sy", "sz"), ("tx", "ty", "tz")
    c = np.array([[m[f"c_{a}_{b}"] for b in s] for a in t], float)
    u, d, v = np.linalg.svd(c)
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ v)) or 1.0])
    r = u @ flip @ v
    scale = float((d * np.diag(flip)).sum() / m["variance"]) if m["variance"] else 1.0
    ms, mt = (np.array([m[f"m_{k}"] for k in ks]) for ks in (s, t))
    return scale, r, mt - scale * r @ ms


def fit_similarity(pairs: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    """Of pairs (sx, sy, sz, tx, ty, tz): one row of sums reaches the driver."""
    return similarity(mean_covariance(pairs).first().asDict())


def apply_similarity(points: DataFrame, scale: float, r: np.ndarray, t: np.ndarray) -> DataFrame:
    x = [F.col(c) for c in "xyz"]
    return points.withColumns({c: sum((float(scale * r[i, j]) * x[j] for j in range(3)), F.lit(float(t[i]))) for i, c in enumerate("xyz")})


def _fit(s: np.ndarray, t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    ms, mt = s.mean(axis=0), t.mean(axis=0)
    u, d, v = np.linalg.svd((t - mt).T @ (s - ms) / len(s))
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ v)) or 1.0])
    var = ((s - ms) ** 2).sum() / len(s)
    scale = float((d * np.diag(flip)).sum() / var) if var > 0 else 1.0
    r = u @ flip @ v
    return scale, r, mt - scale * r @ ms


def robust_similarity(s: np.ndarray, t: np.ndarray, metres: float = RANSAC_METRES) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Seeded RANSAC of camera centres (s) to positions (t), one survey's photos; also which rows are inliers."""
    if len(s) < LEAST_PAIRS:
        raise AlignmentError("fewer than three photos have a position", "georef_too_few")
    rng, best = np.random.default_rng(SEED), np.zeros(len(s), bool)
    off = lambda f: np.linalg.norm(f[0] * s @ f[1].T + f[2] - t, axis=1)
    for _ in range(DRAWS):
        pick = rng.choice(len(s), 3, replace=False)
        a = s[pick]
        if np.linalg.norm(np.cross(a[1] - a[0], a[2] - a[0])) < 1e-9:
            continue
        ok = off(_fit(a, t[pick])) <= metres
        if ok.sum() > best.sum():
            best = ok
    if best.sum() < LEAST_PAIRS:
        raise AlignmentError("positions don't agree with the reconstruction", "georef_mismatch")
    for _ in range(3):
        best = off(_fit(s[best], t[best])) <= metres
    return (*_fit(s[best], t[best]), best)


def largest(reconstructions: DataFrame) -> DataFrame:
    """(survey, reconstruction) with most registered images, ties to the smaller id."""
    return reconstructions.groupBy("survey", "reconstruction").agg(F.count("*").alias("n")).withColumn("rn", F.row_number().over(Window.partitionBy("survey").orderBy(F.desc("n"), "reconstruction"))).filter("rn = 1").select("survey", "reconstruction")


def adjust_points(observations: DataFrame, points: DataFrame) -> DataFrame:
    """One Gauss-Newton step of points (point_id, x, y, z) with fixed cameras.

    observations: point_id, u, v, fx, fy, cx, cy, r (nine), t (three). Normal equations are summed by point, each a 3x3 system
    solved where it is.
    """
    o = observations.join(points, "point_id")
    r, x = [F.col("r")[i] for i in range(9)], [F.col(c) for c in "xyz"]
    p = [r[3 * i] * x[0] + r[3 * i + 1] * x[1] + r[3 * i + 2] * x[2] + F.col("t")[i] for i in range(3)]
    o = o.withColumns({"p0": p[0], "p1": p[1], "p2": p[2]}).filter("p2 > 0")
    iz = 1.0 / F.col("p2")
    ju = [F.col("fx") * iz * (r[j] - F.col("p0") * iz * r[6 + j]) for j in range(3)]
    jv = [F.col("fy") * iz * (r[3 + j] - F.col("p1") * iz * r[6 + j]) for j in range(3)]
    eu, ev = F.col("u") - (F.col("fx") * F.col("p0") * iz + F.col("cx")), F.col("v") - (F.col("fy") * F.col("p1") * iz + F.col("cy"))
    sums = o.groupBy("point_id").agg(F.count("*").alias("k"), *(F.sum(ju[i] * ju[j] + jv[i] * jv[j]).alias(f"a{i}{j}") for i in range(3) for j in range(i, 3)), *(F.sum(ju[i] * eu + jv[i] * ev).alias(f"b{i}") for i in range(3)))
    a = [[F.col(f"a{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)]
    det = lambda m: m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    # a system of rays that nearly coincide moves nothing
    sure = F.abs(det(a)) > 1e-9 * a[0][0] * a[1][1] * a[2][2]
    step = [F.when(sure, F.try_divide(det([[F.col(f"b{i}") if j == k else a[i][j] for j in range(3)] for i in range(3)]), det(a))) for k in range(3)]
    moved = sums.filter("k >= 2").select("point_id", *(s.alias(f"d{c}") for c, s in zip("xyz", step)))
    return points.join(moved, "point_id", "left").select("point_id", *((F.col(c) + F.coalesce(f"d{c}", F.lit(0.0))).alias(c) for c in "xyz"))


def spatial_pairs(positions: DataFrame, k: int = 15, metres: float = 500.0) -> DataFrame:
    """(survey, a, b), a < b: photos to match, each with its k nearest within a distance; height is ignored."""
    from .surface import knn

    near = knn(positions, k, metres, key="image_id")
    return near.select("survey", F.least("image_id", "other").alias("a"), F.greatest("image_id", "other").alias("b")).distinct()


def intrinsics_may_move(gcps: DataFrame, height: float, least: int = 4, relief: float = 0.02) -> bool:
    """Enough control points, and heights that differ by a share of the flying height."""
    row = gcps.agg(F.count("*").alias("n"), (F.max("z") - F.min("z")).alias("relief")).first()
    return row.n >= least and (row.relief or 0.0) >= relief * height
