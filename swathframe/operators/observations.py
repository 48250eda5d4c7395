"""Reprojection errors and what is made of them: statistics, filters, reports, control points.

Observations are rows (point_id, image_id, p2d_idx, err) or, before errors are known, with measured u, v.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.camera import once, pixel
from ..functions.scalars import rms
from .quantiles import quantile

#: Error of a point that can't be projected.
LOST = 1e6
# Thresholds of the sweep in pixels, the share that may go, edges of the histogram.
THRESHOLDS, MOST_REMOVED, BIN, BINS = (0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0), 0.10, 0.25, 21


def observation_errors(observations: DataFrame, points: DataFrame, images: DataFrame, cameras: DataFrame) -> DataFrame:
    """observations (point_id, image_id, p2d_idx, u, v) with err: pixel distance of the projected point.

    points: point_id, x, y, z. images: image_id, camera_id, r (nine), t (three). cameras: camera_id, lens (intrinsics).
    """
    rows = observations.join(images, "image_id").join(cameras, "camera_id").join(points, "point_id")
    err = once(pixel(F.col("lens"), F.col("r"), F.col("t"), F.col("x"), F.col("y"), F.col("z")), lambda p: F.hypot(p["u"] - F.col("u"), p["v"] - F.col("v")))
    return rows.select("point_id", "image_id", "p2d_idx", once(err, lambda e: F.when(e < float("inf"), F.nanvl(e, F.lit(LOST))).otherwise(LOST)).alias("err"))


def reproj_stats(obs: DataFrame, exclude: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """Points, observations, mean, RMSE, 95th percentile and maximum (of groups `by`); zeros without observations."""
    if exclude is not None:
        obs = obs.join(exclude.select("point_id").distinct(), "point_id", "left_anti")
    e = F.col("err")
    zero = lambda c, n: F.coalesce(c, F.lit(0.0)).alias(n)
    sums = [F.count("*").alias("num_observations"), zero(F.avg(e), "mean_px"), zero(F.sqrt(F.avg(e * e)), "rmse_px")]
    if by:
        return obs.groupBy(*by).agg(F.count_distinct("point_id").alias("num_points"), *sums, zero(F.percentile(e, F.lit(0.95)), "p95_px"), zero(F.max(e), "max_px"))
    # of all rows: three results of one row each, none of which gathers the errors in a task
    points = obs.select("point_id").distinct().agg(F.count("point_id").alias("num_points"))
    high = quantile(obs, "err", 0.95, "p").select(zero(F.col("p"), "p95_px"))
    whole = points.crossJoin(F.broadcast(obs.agg(*sums, zero(F.max(e), "max_px")))).crossJoin(F.broadcast(high))
    return whole.select("num_points", "num_observations", "mean_px", "rmse_px", "p95_px", "max_px")


def filter_large_errors(obs: DataFrame, most: float, protect: DataFrame | None = None) -> DataFrame:
    """Observations at or under `most` pixels, of points that keep two; protected points keep all of theirs."""
    kept = obs
    if protect is not None:
        kept = kept.join(protect.select("point_id").distinct().withColumn("_safe", F.lit(True)), "point_id", "left")
        kept = kept.filter((F.col("err") <= most) | F.col("_safe")).drop("_safe")
    else:
        kept = kept.filter(F.col("err") <= most)
    return kept.withColumn("_k", F.count("*").over(Window.partitionBy("point_id"))).filter("_k >= 2").drop("_k")


def removed_count(obs: DataFrame, most: float) -> DataFrame:
    """How many observations a filter takes out one by one: a point's last one goes with its second last."""
    per = obs.groupBy("point_id").agg(F.count_if(F.col("err") > most).alias("bad"), F.count("*").alias("track"))
    return per.agg(F.coalesce(F.sum(F.least(F.col("bad"), F.greatest(F.col("track") - 1, F.lit(1)))), F.lit(0)).alias("removed"))


def point_errors(obs: DataFrame) -> DataFrame:
    """(point_id, rmse, max, track) of each point."""
    return obs.groupBy("point_id").agg(F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("error_px"), F.max("err").alias("max_px"), F.count("*").alias("track"))


def worst_points(obs: DataFrame, top: int = 300) -> DataFrame:
    """The points of largest error (to nine digits, since sums differ beyond with the order of rows), ties by id: a bounded report."""
    return point_errors(obs).orderBy(F.desc(F.round("error_px", 9)), "point_id").limit(top)


def per_image(obs: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """(image_id, num_obs, rmse_px), images without observations included if given."""
    found = obs.groupBy("image_id").agg(F.count("*").alias("num_obs"), F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse_px"))
    if images is None:
        return found
    return images.select("image_id").distinct().join(found, "image_id", "left").withColumn("num_obs", F.coalesce("num_obs", F.lit(0)))


def threshold_sweep(obs: DataFrame, deleted: DataFrame | None = None, thresholds=THRESHOLDS) -> DataFrame:
    """(threshold_px, removed_obs, removed_ratio, rmse_px_after), all thresholds in one pass over the observations."""
    if deleted is not None:
        obs = obs.join(deleted.select("point_id").distinct(), "point_id", "left_anti")
    e = F.col("err")
    parts = [x for i, t in enumerate(thresholds) for x in (F.count_if(e > t).alias(f"n{i}"), F.sqrt(F.avg(F.when(e <= t, e * e))).alias(f"r{i}"))]
    one = obs.agg(F.count("*").alias("n"), *parts)
    rows = F.array(*(F.struct(F.lit(float(t)).alias("threshold_px"), F.col(f"n{i}").alias("removed_obs"), F.coalesce(F.try_divide(f"n{i}", "n"), F.lit(0.0)).alias("removed_ratio"), F.coalesce(f"r{i}", F.lit(0.0)).alias("rmse_px_after")) for i, t in enumerate(thresholds)))
    return one.select(F.inline(rows))


def recommended_threshold(sweep: DataFrame) -> DataFrame:
    """The smallest threshold that removes no more than MOST_REMOVED; else the largest."""
    return sweep.agg(F.coalesce(F.min(F.when(F.col("removed_ratio") <= MOST_REMOVED, F.col("threshold_px"))), F.max("threshold_px")).alias("recommended_px"))


def error_histogram(obs: DataFrame) -> DataFrame:
    """(bin, low, count) of errors in bins of BIN pixels, the last one open; empty bins count 0."""
    b = F.least(F.floor(F.col("err") / BIN).cast("int"), F.lit(BINS - 1))
    counted = obs.groupBy(b.alias("bin")).agg(F.count("*").alias("count"))
    return obs.sparkSession.range(BINS).select(F.col("id").cast("int").alias("bin"), (F.col("id") * BIN).alias("low")).join(counted, "bin", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def hashed_sample(rows: DataFrame, key: str, most: int, by: str | None = None, seed: int = 0) -> DataFrame:
    """At most `most` rows (of each group `by`) in the order of a hash of their key: the same on every run and partitioning."""
    order = [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key)]
    if by is None:
        return rows.orderBy(*order).limit(most)
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_rn") <= most).drop("_rn")


def map_points(obs: DataFrame, top: int = 300, most: int = 15000) -> DataFrame:
    """All of the worst points and a hashed sample of the others."""
    points = point_errors(obs)
    worst = points.orderBy(F.desc(F.round("error_px", 9)), "point_id").limit(top)
    rest = points.join(worst.select("point_id"), "point_id", "left_anti")
    return worst.unionByName(hashed_sample(rest, "point_id", most - top))


def resolve_marks(marks: DataFrame, images: DataFrame) -> DataFrame:
    """marks (gcp, ordinal, image, x, y) with the image_id of the posed image of that name, or of that name and `.jpg`; the first
    mark of a control point in an image counts."""
    known = images.filter("has_pose").select("name", "image_id")
    second = known.select(F.col("name").alias("name2"), F.col("image_id").alias("id2"))
    found = marks.join(known, marks["image"] == known["name"], "left").join(second, F.concat(marks["image"], F.lit(".jpg")) == second["name2"], "left")
    found = found.withColumn("image_id", F.coalesce("image_id", "id2")).filter("image_id is not null").drop("name", "name2", "id2")
    return found.withColumn("_rn", F.row_number().over(Window.partitionBy("gcp", "image_id").orderBy("ordinal"))).filter("_rn = 1").drop("_rn")


def residuals(x: Column, y: Column, z: Column, sx: Column, sy: Column, sz: Column) -> Column:
    """Struct dx, dy, dz, dxy, d3 of an estimated less a surveyed position."""
    dx, dy, dz = x - sx, y - sy, z - sz
    return F.struct(dx.alias("dx"), dy.alias("dy"), dz.alias("dz"), F.hypot(dx, dy).alias("dxy"), F.sqrt(dx * dx + dy * dy + dz * dz).alias("d3"))


def gcp_summary(table: DataFrame) -> DataFrame:
    """Of each role: count and RMSE of the residuals of points that have them."""
    return table.filter("dx is not null").groupBy("role").agg(F.count("*").alias("count"), *(rms(F.col(c)).alias(n) for c, n in (("dx", "rmse_x"), ("dy", "rmse_y"), ("dz", "rmse_z"), ("dxy", "rmse_xy"), ("d3", "rmse_3d"))))


def triangulation_sums(rays: DataFrame, by: str = "gcp") -> DataFrame:
    """Normal equations of the point nearest to rays (origin ox, oy, oz, unit direction dx, dy, dz), summed where they are."""
    d, o = [F.col(c) for c in ("dx", "dy", "dz")], [F.col(c) for c in ("ox", "oy", "oz")]
    m = [[(1.0 if i == j else 0.0) - d[i] * d[j] for j in range(3)] for i in range(3)]
    sums = [F.sum(m[i][j]).alias(f"a{i}{j}") for i in range(3) for j in range(i, 3)]
    return rays.groupBy(by).agg(F.count("*").alias("rays"), *sums, *(F.sum(sum((m[i][j] * o[j] for j in range(1, 3)), m[i][0] * o[0])).alias(f"b{i}") for i in range(3)))


def triangulate(rays: DataFrame, by: str = "gcp") -> DataFrame:
    """(by, x, y, z) of points with at least two rays, by Cramer's rule; null where the rays are parallel."""
    s = triangulation_sums(rays, by)
    a = [[F.col(f"a{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)]
    b = [F.col(f"b{i}") for i in range(3)]
    det = lambda m: m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    whole = det(a)
    place = lambda k: [[b[i] if j == k else a[i][j] for j in range(3)] for i in range(3)]
    ok = (F.col("rays") >= 2) & (F.abs(whole) > 1e-12)
    return s.select(by, "rays", *(F.when(ok, det(place(k)) / whole).alias(c) for k, c in enumerate("xyz")))


def gps_residual(cameras: DataFrame, gps: DataFrame) -> DataFrame:
    """Horizontal RMS distance of camera centres (name, x, y) from their GPS positions (name, gx, gy)."""
    d = cameras.join(gps, "name").select((F.pow(F.col("x") - F.col("gx"), 2) + F.pow(F.col("y") - F.col("gy"), 2)).alias("d"))
    return d.agg(F.count("*").alias("n"), F.sqrt(F.avg("d")).alias("rms_m"))


def sparse_points(points: DataFrame, most_error: float = 2.0, least_track: int = 3) -> DataFrame:
    return points.filter((F.col("error") <= most_error) & (F.col("track") >= least_track))


def mean_covariance(pairs: DataFrame) -> DataFrame:
    """Means, cross-covariance and source variance of pairs (sx, sy, sz, tx, ty, tz): all that a similarity fit needs, one row."""
    s, t = ("sx", "sy", "sz"), ("tx", "ty", "tz")
    return pairs.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m_{c}") for c in (*s, *t)), *(F.covar_pop(a, b).alias(f"c_{a}_{b}") for a in t for b in s), sum((F.var_pop(c) for c in s[1:]), F.var_pop(s[0])).alias("variance"))


def target_system(gcps: DataFrame, base: int, geographic: list[int]) -> DataFrame:
    """One row: the system of all control points if they have one and it is projected, else the base's."""
    one = gcps.filter("role = 'control'").agg(F.count_distinct("epsg").alias("n"), F.min("epsg").alias("epsg"))
    ok = (F.col("n") == 1) & ~F.col("epsg").isin(*geographic)
    return one.select(F.when(ok, F.col("epsg")).otherwise(base).alias("epsg"))


def candidates(predicted: DataFrame, marked: DataFrame) -> DataFrame:
    """Predicted places (gcp, image_id, u, v, width, height) with center_dist and marked, and their place in the order of marking:
    marked images first, then those that show the point nearest to their centre."""
    has = marked.select("gcp", "image_id").distinct().withColumn("marked", F.lit(True))
    rows = predicted.join(has, ["gcp", "image_id"], "left").withColumn("marked", F.coalesce("marked", F.lit(False)))
    rows = rows.withColumn("center_dist", F.hypot((F.col("u") - F.col("width") / 2.0) / F.col("width"), (F.col("v") - F.col("height") / 2.0) / F.col("height")))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("gcp").orderBy(F.desc("marked"), F.round("center_dist", 9), "image_id")))
