from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathframe.errors import AlignmentError, InputError, ProjectError
from swathframe.functions import camera
from swathframe.operators import coverage, grids, mosaic, quantiles, radiometry, rays, scan, sfm, surface
from swathframe.plans.options import GridOptions, PreviewOptions, snapped
from swathframe.plans.scratch import Rounds
from swathframe.plans.workspace import Project


def test_triangles_are_delaunay():
    r = np.random.default_rng(1)
    xy = r.uniform(0, 100, (60, 2))
    t = surface.triangles(xy)
    for a, b, c in xy[t]:
        d = 2 * (a[0] * (b[1] - c[1]) + b[0] * (c[1] - a[1]) + c[0] * (a[1] - b[1]))
        u = np.array([(a @ a) * (b[1] - c[1]) + (b @ b) * (c[1] - a[1]) + (c @ c) * (a[1] - b[1]), (a @ a) * (c[0] - b[0]) + (b @ b) * (a[0] - c[0]) + (c @ c) * (b[0] - a[0])]) / d
        assert (np.linalg.norm(xy - u, axis=1) >= np.linalg.norm(a - u) - 1e-6).all()
    assert set(t.ravel()) == set(range(60))


def test_triangles_of_many_points():
    """Lattices (four points on every circle), lines, far off origins, and as many points as a look at every triangle could not do."""
    for xy in (np.stack(np.meshgrid(np.arange(40) * 0.1 + 7e5, np.arange(30) * 0.4), axis=-1).reshape(-1, 2), np.random.default_rng(3).normal(0, 50, (40000, 2)), np.array([[0, 0], [1, 0], [2, 0], [3, 0], [1.5, 1e-9]], float)):
        t = surface.triangles(xy)
        a, b, c = xy[t[:, 0]], xy[t[:, 1]], xy[t[:, 2]]
        area = np.abs((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])) / 2
        edges, count = np.unique(np.sort(np.concatenate([t[:, :2], t[:, 1:], t[:, ::2]]), axis=1), axis=0, return_counts=True)
        assert len(np.unique(t)) == len(xy) and count.max() <= 2 and len(xy) - len(edges) + len(t) == 1
        hull = xy[edges[count == 1]] - xy.mean(axis=0)
        assert area.sum() == pytest.approx(np.abs(hull[:, 0, 0] * hull[:, 1, 1] - hull[:, 0, 1] * hull[:, 1, 0]).sum() / 2, rel=1e-6)
    assert len(surface.triangles(np.stack([np.arange(9.0), 2 * np.arange(9.0)], axis=1))) == 0
    xyz = np.array([[0, 0, 1], [9, 0, 1], [0, 9, 1], [9, 9, 1], [9, 9, 5]], float)
    assert (surface.interpolated(xyz, 0.0, 9.0, 3.0, 4, 4, smooth=False) == surface.interpolated(xyz[::-1], 0.0, 9.0, 3.0, 4, 4, smooth=False)).all()


def test_surface_keeps_planes(spark):
    r = np.random.default_rng(2)
    xy = np.concatenate([r.uniform(0, 100, (80, 2)), [[0, 0], [0, 100], [100, 0], [100, 100]]])
    z = surface.interpolated(np.column_stack([xy, 3 + 0.5 * xy[:, 0] - 0.2 * xy[:, 1]]), 0.0, 100.0, 10.0, 11, 11, smooth=False)
    x, y = np.meshgrid(10 * np.arange(11), 100 - 10 * np.arange(11))
    assert z == pytest.approx(3 + 0.5 * x - 0.2 * y, abs=1e-6)
    assert (surface.interpolated(np.array([[1.0, 1.0, 7.0]]), 0.0, 10.0, 5.0, 3, 3) == 7).all()
    points = spark.createDataFrame([(1, i, float(i * 7 % 50), float(i * 13 % 50), 10.0 if i else 500.0) for i in range(40)], "survey long, point_id long, x double, y double, z double")
    assert 0 not in {p.point_id for p in surface.remove_z_outliers(points, Rounds(spark).keep).collect()}


def test_z_outliers_of_uneven_surveys(spark):
    """Clusters, lone points, lines and small surveys: as by brute force."""
    r = np.random.default_rng(12)
    rows = [(1, *r.normal(0, 1, 2), r.normal(0, 0.1)) for _ in range(300)] + [(1, *r.uniform(-900, 900, 2), r.normal(5, 1)) for _ in range(30)] + [(2, float(i), 3.0, float(i % 7)) for i in range(60)] + [(3, 0.0, 0.0, 9.0 * i) for i in range(10)] + [(4, 1.0, 1.0, float(i == 0) * 50) for i in range(25)]
    rows = [(s, i, float(x), float(y), float(z)) for i, (s, x, y, z) in enumerate(rows)]
    want = set()
    for s, i, x, y, z in rows:
        others = sorted((float(np.sqrt((a - x) * (a - x) + (b - y) * (b - y))), j, h) for q, j, a, b, h in rows if q == s and j != i)
        near = np.array([h for _, _, h in others[:16]])
        if len(others) < 16 or abs(z - np.median(near)) <= 3 * (1.4826 * np.median(np.abs(near - np.median(near))) + 0.05):
            want.add(i)
    points = spark.createDataFrame(rows, "survey long, point_id long, x double, y double, z double")
    assert {p.point_id for p in surface.remove_z_outliers(points, Rounds(spark).keep).collect()} == want and len(want) < len(rows)


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [0.0, 0.0, 5.0, -2.5, -2.5, 1e-9, 1e9], [float(i % 5) for i in range(101)], list(np.random.default_rng(1).lognormal(0, 2, 400)), []])
def test_quantile(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    for share in (0.0, 0.05, 0.5, 0.95, 1.0):
        got = quantiles.quantile(df, "v", share, "q").first().q
        assert got is None if not values else got == pytest.approx(float(np.quantile(values, share)), rel=1e-12, abs=1e-15)


def test_rays_meet_a_surface():
    z = np.fromfunction(lambda r, c: 2 + np.sin(r / 5.0) + c * 0.03, (40, 50))
    sample = lambda x, y: rays.bilinear(z, 0.0, 39.0, 1.0, x, y)
    r = np.random.default_rng(2)
    o = np.column_stack([r.uniform(5, 45, (50, 2)) * [1, 0.8], np.full(50, 30.0)])
    d = np.column_stack([r.normal(0, 0.2, (50, 2)), np.full(50, -1.0)])
    d[7] = [0, 0, 1]
    p = rays.meet(o, d / np.linalg.norm(d, axis=1)[:, None], sample, 2.0, 40, 1e-4, True)
    ok = np.arange(50) != 7
    assert np.isnan(p[7]).all() and np.abs(p[ok, 2] - sample(p[ok, 0], p[ok, 1])).max() < 2e-3
    assert np.abs(np.cross(p[ok] - o[ok], d[ok])).max() < 1e-6
    assert rays.bilinear(z, 0.0, 39.0, 1.0, np.array([3.0, -9.0, 3.5]), np.array([36.0, 99.0, 35.5])) == pytest.approx([z[3, 3], z[0, 0], z[3:5, 3:5].mean()])


def test_pixels_without_their_distortion(spark):
    lens = camera.intrinsics(F.lit("OPENCV"), F.array(*(F.lit(v) for v in (3000.0, 3100.0, 2000.0, 1500.0, -0.1, 0.02, 0.001, -0.002))))
    df = spark.range(9).select(lens.alias("c"), ((F.col("id") - 4) / 10.0).alias("x"), ((F.col("id") % 3 - 1) / 5.0).alias("y"))
    u, v = camera.distorted(F.col("c"), F.col("x"), F.col("y"))
    for row in df.withColumns({"u": u, "v": v}).withColumn("p", camera.undistorted(F.col("c"), F.col("u"), F.col("v"))).collect():
        assert (row.p.x, row.p.y) == pytest.approx((row.x, row.y), abs=1e-8)


def test_labels():
    mask = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 1, 1, 1]], bool)
    assert grids.labels_of(mask).tolist() == [[1, 0, 0, 2], [0, 1, 0, 2], [0, 0, 0, 0], [3, 3, 3, 3]]
    snake = np.zeros((9, 9), bool)
    snake[::2] = True
    snake[1::4, 8] = snake[3::4, 0] = True
    assert grids.labels_of(snake).max() == 1


def test_discs():
    r = np.random.default_rng(8)
    mask = r.random((30, 40)) < 0.03
    i, j = np.nonzero(mask)
    y, x = np.indices(mask.shape)
    for radius in (1.0, 1.5, 3.7, 9.0):
        near = (np.hypot(y[..., None] - i, x[..., None] - j) <= radius).any(axis=-1)
        assert (grids.dilated(mask, radius) == near).all() and (grids.eroded(~mask, radius) == ~near).all()


def test_survey_area(spark):
    ring = np.ones((7, 7), bool)
    ring[2:5, 2:5] = False
    assert grids.filled(ring).all()
    split = np.zeros((20, 40), bool)
    split[5:15, 2:18] = split[5:15, 21:38] = True
    assert grids.survey_area(split, 4.0)[6:14, 18:21].all() and not grids.survey_area(split, 1.0)[:, 19].any()
    notch = np.ones((20, 20), bool)
    notch[:3, 8:11] = False
    assert not grids.survey_area(notch, 4.0)[0, 9]
    i, j = np.nonzero(split)
    cells = spark.createDataFrame([(1, int(a), int(b), 3, 2.0) for a, b in zip(i, j)], "survey long, row int, col int, n long, cell double")
    s = coverage.coverage_stats(grids.area_cells(cells, 8.0, 4.0)).first()
    assert s.gap_area_m2 >= 8 * 3 * 4 and s.survey_area_m2 == s.gap_area_m2 + split.sum() * 4 and s.overlap_median == 3


def test_area_counts(spark):
    """Counts of alike cells from spans, as from cells; discs wider than the grid."""
    r = np.random.default_rng(6)
    rows = [(s, row, int(c), int(c) + int(r.integers(1, 3)), int(r.integers(1, 4)), 2.0) for s in range(3) for row in range(12) for c in range(0, 24, 3) if r.random() < 0.6]
    spans = spark.createDataFrame(rows, "survey long, row int, col int, after int, n int, cell double")
    area = grids.area_cells(spans.select("survey", "row", F.explode(F.sequence("col", F.col("after") - 1)).alias("col"), "n", "cell"), 4.0, 2.0)
    counts = grids.area_counts(spans, 4.0, 2.0)
    keys = ["survey", "n", "gap", "interior", "cell"]
    assert sorted(counts.collect()) == sorted(area.groupBy(*keys).agg(F.count("*").alias("cells")).collect())
    assert sorted(coverage.coverage_stats(counts).collect()) == sorted(coverage.coverage_stats(area).collect())
    assert grids.dilated(np.array([[True, False, False]]), 1.0).tolist() == [[True, True, False]] and grids.dilated(np.array([[True, False]]), 9.0).all()


def test_overlap():
    square = lambda x: [(x, 0.0), (x + 2, 0.0), (x + 2, 2.0), (x, 2.0)]
    assert coverage.clipped_area(square(0), square(1)) == pytest.approx(2.0) and coverage.clipped_area(square(0), square(5)) == 0.0
    assert coverage.clipped_area(square(0)[::-1], square(1)[::-1]) == pytest.approx(2.0)


def test_coverage_of_a_turned_print(spark):
    poses = spark.createDataFrame([("s", "a", "1", 0.0, 0.0, 100.0, 45.0, -90.0, 2000, 2000, 1000.0)], "survey string, file string, datetime string, e double, n double, h double, yaw double, pitch double, width int, height int, focal double")
    prints = coverage.footprints(poses)
    grid = coverage.coverage_grid(prints, coverage.survey_bounds(prints, 200))
    cell = coverage.survey_bounds(prints, 200).first().cell
    assert grid.count() * cell * cell == pytest.approx(200.0 * 200.0, rel=0.02)


def test_cameras(spark):
    rows = [("s", "d/A_1_W.JPG", "m", "x", "wide", 9.0, 24.0, True), ("s", "d/A_2_T.JPG", "m", "x", "tele", 7.0, 20.0, True), ("s", "d/B.JPG", "m", "y", "only", 9.0, None, True)]
    shots = spark.createDataFrame(rows, "survey string, file string, make string, model string, camera_key string, focal_mm double, focal_35mm double, selected boolean")
    assert {(r.camera_key, r.kept) for r in scan.select_mapping_cameras(shots).collect()} == {("wide", True), ("tele", False), ("only", True)}
    assert {r.file for r in scan.with_selection(shots).filter("selected").collect()} == {"d/A_1_W.JPG", "d/B.JPG"}


def test_gains_are_found(spark):
    r = np.random.default_rng(3)
    truth = r.normal(0, 0.1, 8)
    rows = [(p, c, float(np.log(0.2 + 0.01 * p) - truth[c] + r.normal(0, 0.002))) for p in range(60) for c in r.choice(8, 4, replace=False).tolist()]
    got = {x.capture: x.gain for x in radiometry.solve_capture_gains(spark.createDataFrame(rows, "point long, capture long, v double"), Rounds(spark).keep, rounds=12).collect()}
    assert np.array([got[c] for c in range(8)]) == pytest.approx(truth - truth.mean(), abs=0.03)


def test_gains_keep_one_table(spark):
    """Disk does not grow with rounds, rows without a value and points of one row change nothing, weights that vanish are no error."""
    rows = [(p, c, 0.1 * p + 0.01 * c + (5.0 if (p, c) == (3, 1) else 0.0)) for p in range(30) for c in range(4)] + [(99, 9, 1.0), (98, 0, None), (97, 2, -50.0), (97, 3, 50.0)]
    held = Rounds(spark, last=1)
    found = radiometry.solve_capture_gains(spark.createDataFrame(rows, "point long, capture long, v double"), held.keep, rounds=6)
    assert {x.capture: x.gain for x in found.collect()} == pytest.approx({c: 0.015 - 0.01 * c for c in range(4)}, abs=0.01)
    root = Path(held.root.removeprefix("file://"))
    assert held.n > 4 and [x.name for x in root.iterdir()] == [str(held.n)]


def test_robust_fit():
    r = np.random.default_rng(4)
    x, y = r.uniform(-1, 1, (2, 400))
    a = np.stack(mosaic.basis(x, y), axis=1)
    truth = np.array([0.1, 0.2, -0.1, 0.05, 0.0, 0.02])
    b = a @ truth
    b[::10] += 3
    assert mosaic.robust_fit(a, b, np.ones(400)) == pytest.approx(truth, abs=0.02)
    assert (mosaic.robust_fit(a[:10], b[:10], np.ones(10)) == 0).all()


def test_alignment():
    r = np.random.default_rng(5)
    s = r.uniform(-50, 50, (30, 3))
    q, _ = np.linalg.qr(r.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    t = 2.5 * s @ q.T + [100, 200, 300]
    t[:5] += 500
    scale, rot, shift, ok = sfm.robust_similarity(s, t)
    assert scale == pytest.approx(2.5) and rot == pytest.approx(q) and shift == pytest.approx([100, 200, 300]) and ok.sum() == 25
    with pytest.raises(AlignmentError) as e:
        sfm.robust_similarity(s[:2], t[:2])
    assert e.value.code == "georef_too_few"


def test_options():
    assert GridOptions.restored({"gsd_m": 0.1, "bounds": [0, 0, 1, 1], "later": 3, "origin": None}) == GridOptions(gsd_m=0.1, bounds=(0, 0, 1, 1))
    assert GridOptions.restored(GridOptions(gsd_scale=2.0, origin=(1.0, 2.0)).stored()) == GridOptions(gsd_scale=2.0, origin=(1.0, 2.0))
    for bad in ({"gsd_m": -1}, {"gsd_m": float("nan")}, {"gsd_scale": 0}, {"bounds": (0, 0, 0, 1)}, {"bounds": (0, 1)}):
        with pytest.raises(InputError):
            GridOptions(**bad)
    with pytest.raises(InputError):
        PreviewOptions(max_size=0)
    assert snapped((0.05, 0.0, 0.95, 1.0), 0.1) == pytest.approx((0.0, 0.0, 1.0, 1.0))


def test_masks_change_the_surface(spark, tmp_path):
    """A pond whose cells the photos' masks show, with rough heights and no points inside, becomes level; masks of other photos do nothing."""
    root = f"file://{tmp_path}/w"
    p = Project(spark, root)
    nadir = [1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, -1.0]
    images = spark.createDataFrame([(i, f"{i}.JPG", 1, True, nadir, [-(40.0 + 20 * i), 50.0, 80.0]) for i in range(2)], "image_id long, name string, camera_id long, has_pose boolean, r array<double>, t array<double>")
    cameras = spark.createDataFrame([(1, 4000, 3000, (1500.0, 1500.0, 2000.0, 1500.0, 0.0, 0.0, 0.0, 0.0, 0.0))], "camera_id long, width int, height int, lens struct<fx:double,fy:double,cx:double,cy:double,k1:double,k2:double,p1:double,p2:double,k3:double>")
    pond = lambda x, y: abs(x - 50) < 13 and abs(y - 50) < 13
    xyz = [(k, float(x), float(y), 3.0 + 0.01 * ((x + y) % 7)) for k, (x, y) in enumerate((x, y) for x in range(0, 101, 2) for y in range(0, 101, 2) if max(abs(x - 50), abs(y - 50)) > 14)]
    points = spark.createDataFrame(xyz, "point_id long, x double, y double, z double")
    obs = spark.createDataFrame([(k, i, k, 0.0, 0.0) for k, *_ in xyz[:5] for i in range(2)], "point_id long, image_id long, p2d_idx long, u double, v double")
    p.align(points, images, cameras, obs, 5186)
    with pytest.raises(ProjectError):
        p.treat_water("on")
    cells = [(r, c, 9.0 if pond(4.0 * c, 100 - 4.0 * r) else 3.0) for r in range(26) for c in range(26)]
    p.set_surface(spark.createDataFrame(cells, "row int, col int, z double"), 0.0, 100.0, 4.0, 26, 26)
    assert p.treat_water()["active"] is False

    def mask(i):  # a photo's pixel on the ground, 80 m below, at the level of 3
        for v in range(100):
            for u in range(133):
                x, y = 40 + 20 * i + ((u + 0.5) * 4000 / 133 - 2000) / 1500 * 77, 50 - ((v + 0.5) * 30 - 1500) / 1500 * 77
                yield f"{i}.JPG", v, u, 200 * int(pond(x, y))

    kind = "image string, v int, u int, mask int"
    rows = [m for i in range(2) for m in mask(i)]
    p.set_water_masks(spark.createDataFrame([("other.JPG", v, u, m) for _, v, u, m in rows], kind))
    assert p.treat_water("on")["active"] is False
    p.set_water_masks(spark.createDataFrame(rows, kind))
    with pytest.raises(InputError):
        p.treat_water("maybe")
    info = p.treat_water("on")
    assert info["active"] and info["source"] == "user" and len(info["bodies"]) == 1 and info["images_with_water"] == 2
    level = info["bodies"][0]["level_m"]
    z = {(r.row, r.col): r.z for r in p.store.table("surface").collect()}
    deep = [(r, c) for r, c, _ in cells if abs(4 * c - 50) < 10 and abs(50 - 4 * r) < 10]
    assert level == pytest.approx(3.03, abs=0.04) and all(z[k] == pytest.approx(level) for k in deep)
    assert all(z[r, c] == 3.0 for r, c, _ in cells if abs(4 * c - 50) > 22 or abs(50 - 4 * r) > 22)
    assert p.treat_water("off")["bodies"] == [] and {(r.row, r.col): r.z for r in p.store.table("surface").collect()} == {(r, c): h for r, c, h in cells}
    p.set_water_masks(None)
    assert p.water_masks() is None


def test_workspace(spark, tmp_path):
    shots = spark.createDataFrame(
        [("s", f"{i:03d}.JPG", "m", "x", "k", 9.0, 24.0, 127.0 + i * 1e-4, 37.0, 100.0, 60.0, 10.0, 10.0, -90.0, 50, 4000, 3000, True, f"2024:01:01 00:00:{i:02d}") for i in range(6)],
        "survey string, file string, make string, model string, camera_key string, focal_mm double, focal_35mm double, lon double, lat double, abs_alt double, rel_alt double, gimbal_yaw double, flight_yaw double, gimbal_pitch double, rtk_flag int, width int, height int, selected boolean, datetime string",
    )
    root = f"file://{tmp_path}/w"
    p = Project.create(shots, root)
    seen = p.preview()
    assert seen["epsg"] == 32652 and seen["surveys"][0]["overlap_median"] >= 1
    with pytest.raises(ProjectError) as e:
        Project.open(spark, root)
    assert e.value.code == "not_aligned"

    r = np.random.default_rng(6)
    xyz = np.column_stack([r.uniform(0, 100, (40, 2)), r.uniform(0, 5, 40)])
    centres = [(i, 20.0 * i, 50.0, 80.0) for i in range(6)]
    nadir = [1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, -1.0]
    points = spark.createDataFrame([(i, *(xyz[i] + r.normal(0, 0.02, 3)).tolist()) for i in range(40)], "point_id long, x double, y double, z double")
    images = spark.createDataFrame([(i, f"{i:03d}.JPG", 1, True, nadir, [-x, y, z]) for i, x, y, z in centres], "image_id long, name string, camera_id long, has_pose boolean, r array<double>, t array<double>")
    cameras = spark.createDataFrame([(1, 4000, 3000, (3000.0, 3000.0, 2000.0, 1500.0, 0.0, 0.0, 0.0, 0.0, 0.0))], "camera_id long, width int, height int, lens struct<fx:double,fy:double,cx:double,cy:double,k1:double,k2:double,p1:double,p2:double,k3:double>")
    uv = [(k, i, k, 2000 + 3000 * (q[0] - x) / (z - q[2]), 1500 - 3000 * (q[1] - y) / (z - q[2])) for i, x, y, z in centres for k, q in enumerate(xyz)]
    obs = spark.createDataFrame([(k, i, n, float(u), float(v)) for k, i, n, u, v in uv], "point_id long, image_id long, p2d_idx long, u double, v double")
    before = p.align(points, images, cameras, obs, 5186)["reprojection"]
    assert 0.1 < before["rmse_px"] < 3 and p.current() == "base"

    p.set_edits(deleted_points=[3, 1, 3], max_reproj_error_px=5.0)
    with pytest.raises(InputError) as e:
        p.set_edits(gcps=[{"name": "A", "x": "?", "y": 0, "z": 0, "epsg": 5186}])
    assert e.value.code == "invalid_edits" and p.edits()["deleted_points"] == [1, 3]
    first, second = p.refine(), p.refine()
    assert first["after"]["rmse_px"] < 0.1 * before["rmse_px"] and first["after"] == second["after"] and first["after"]["num_points"] == 38
    assert p.current() == "refined" and p.points().count() == 38 and p.cameras().count() == 6 and p.info().filter("registered").count() == 6
    assert p.predict(20.0, 50.0, 0.0).first().image_id == 1
    stats = p.tiepoint_stats()
    assert stats["thresholds"].count() == 10 and stats["histogram"].agg(F.sum("count")).first()[0] == stats["summary"].first().num_observations
    p.reset_refinement()
    assert p.current() == "base" and p.edits()["deleted_points"] == [1, 3]

    with pytest.raises(ProjectError):
        p.mosaic()
    samples = spark.createDataFrame([("s", i % 4, i // 4 % 4, i % 3, float(i), 0.3 + i / 100, 0.1) for i in range(48)], "survey string, row int, col int, view int, r double, nir double, red double")
    assert p.render(samples, ["nir", "red"], 5.0).count() == 16
    assert p.make_indices({"nir": "nir", "red": "red"}, ["NDVI"]).columns == ["survey", "row", "col", "ndvi"]
    assert p.overviews("nir", 512)[0].count() == 4 and set(p.report()) >= {"align", "render", "warnings"}
    with pytest.raises(InputError):
        p.render(samples, ["nir"], 5.0, GridOptions(gsd_m=2.0))
    placed = samples.selectExpr("survey", "col * 2.0 + 101.0 as x", "200.0 - row * 2.0 - 1.0 as y", "view", "r", "nir", "red")
    assert p.render(placed, ["nir"], 5.0, GridOptions(gsd_m=2.0, bounds=(100.0, 192.0, 104.0, 200.0))).count() == 8
    assert p.store.get("render")["grid"] == {"xmin": 100.0, "ymax": 200.0, "res": 2.0, "rows": 4, "cols": 2}
    assert p.render(placed, ["nir"], 5.0, GridOptions(gsd_scale=2.0), native_gsd=1.0).count() == 16

    # pixels to the ground and back
    pixels = spark.createDataFrame([(i, 500.0 * i + 10, 2900.0 - 300 * i) for i in range(8)], "pixel_id long, u double, v double")
    ground = p.image_to_ground("002.JPG", pixels, z=1.5)
    back = p.ground_to_image("002.JPG", ground).orderBy("pixel_id").collect()
    assert [(b.u, b.v) for b in back] == [pytest.approx((500.0 * i + 10, 2900.0 - 300 * i)) for i in range(8)]
    with pytest.raises(KeyError):
        p.image_to_ground("none.JPG", pixels, z=0.0)
    with pytest.raises(ProjectError):
        p.image_to_ground("002.JPG", pixels)
    p.set_surface(spark.range(40 * 50).selectExpr("cast(id div 50 as int) as row", "cast(id % 50 as int) as col", "0.05D * (id % 50) as z"), -20.0, 120.0, 4.0, 40, 50)
    for r in p.image_to_ground("002.JPG", pixels).collect():
        assert r.z == pytest.approx(min(max((r.x + 20) / 4, 0), 49) * 0.05, abs=0.006)

    # a mosaic from photos of one colour each: every cell has that of the photo whose centre is nearest to it
    photos = spark.createDataFrame([(i, a, b, 10.0 * i) for i in range(6) for a in range(6) for b in range(8)], "view long, prow int, pcol int, grey double")
    seen = p.look().collect()
    nearest = {}
    for s in seen:
        assert s.u == pytest.approx(2000 + 3000 * (-20 + 4 * s.col - 20.0 * s.view) / (80 - 0.05 * s.col)) and s.r == pytest.approx(np.hypot(s.u - 2000, s.v - 1500))
        nearest.setdefault((s.row, s.col), []).append((s.r, s.view))
    got = {(r.row, r.col): r.grey for r in p.render_photos(photos, ["grey"], 0.01).collect()}
    assert set(got) == set(nearest) and all(min(abs(got[c] - 10 * v) for q, v in looks if q < min(looks)[0] + 0.1) < 5.1 for c, looks in nearest.items())
    for size in (7.0, 1000.0):
        assert {(r.row, r.col): r.grey for r in p.render_photos(photos, ["grey"], 0.01, tile=size).collect()} == pytest.approx(got)
