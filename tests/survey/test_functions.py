import math

import pytest
from pyspark.sql import functions as F

from swathframe.errors import InputError
from swathframe.functions import camera, geodesy, indices, scalars


def one(spark, *columns):
    row = spark.range(1).select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


def test_projection_spots(spark):
    x, y = one(spark, *geodesy.forward(F.lit(127.0), F.lit(38.0), 5186))
    assert (x, y) == pytest.approx((200000, 600000), abs=1e-6)
    for (lon, lat), epsg in {(129.0, 35.1): 32652, (126.9, 37.5): 32652, (-81.75, 41.3): 32617, (151.2, -33.9): 32756}.items():
        assert one(spark, geodesy.utm_epsg(F.lit(lon), F.lit(lat))) == epsg
        x, y = geodesy.forward(F.lit(lon), F.lit(lat), epsg)
        assert one(spark, *geodesy.inverse(x, y, epsg)) == pytest.approx((lon, lat), abs=1e-9)
    e, n = one(spark, *geodesy.forward(F.lit(129.0), F.lit(35.1), 32652))
    assert 490_000 < e < 510_000 and 3_880_000 < n < 3_890_000
    assert one(spark, *geodesy.transform_xy(F.lit(1.5), F.lit(2.5), 5186, 5186)) == (1.5, 2.5)


def test_systems():
    assert geodesy.is_geographic(4326) and not geodesy.is_geographic(32756)
    with pytest.raises(InputError):
        geodesy.crs(3857)


def test_angles_and_texts(spark):
    assert [one(spark, scalars.wrap_angle(F.lit(a))) for a in (180.0, -180.0, 190.0, -190.0, 720.0)] == [-180, -180, -170, 170, 0]
    assert one(spark, scalars.suffix(F.lit("a/DJI_0001_W.JPG"))) == "W" and one(spark, scalars.suffix(F.lit("DJI_0001.JPG"))) is None
    assert one(spark, scalars.floats(F.lit("1, 2 3.5"))) == [1.0, 2.0, 3.5] and one(spark, scalars.floats(F.lit("1, x"))) is None
    assert one(spark, scalars.dms_to_deg(F.lit(35.0), F.lit(30.0), F.lit(36.0), F.lit("S"))) == pytest.approx(-35.51)
    assert one(spark, scalars.version_parts(F.lit("v0.10.3-rc1"))) == [0, 10, 3] and one(spark, scalars.version_parts(F.lit("2"))) == [2, 0, 0]
    assert one(spark, scalars.in_registry_order(["NDVI", "NDRE"], F.array(F.lit(" ndre"), F.lit("NDVI")))) == ["NDVI", "NDRE"]
    assert one(spark, scalars.is_number(F.lit("1,234.5"))) and not one(spark, scalars.is_number(F.lit("12a")))


def test_camera(spark):
    a = one(spark, camera.camera_axes(F.lit(0.0), F.lit(-90.0)))
    assert a.x == pytest.approx([1, 0, 0]) and a.y == pytest.approx([0, -1, 0]) and a.z == pytest.approx([0, 0, -1])
    lit = F.lit
    x, y = camera.ground_point(lit(10.0), lit(20.0), lit(60.0), lit(0.0), lit(-90.0), lit(3000.0), lit(4000), lit(3000), lit(4000.0), lit(0.0))
    assert one(spark, x, y) == pytest.approx((50.0, 50.0))
    x, y = camera.ground_point(lit(0.0), lit(0.0), lit(60.0), lit(0.0), lit(0.0), lit(3000.0), lit(4000), lit(3000), lit(2000.0), lit(0.0))
    assert math.hypot(*one(spark, x, y)) == pytest.approx(240.0)
    r = camera.rotation_from_opk(lit(3.0), lit(-4.0), lit(50.0))
    o = one(spark, camera.opk_from_rotation(r))
    assert (o.omega, o.phi, o.kappa) == pytest.approx((3.0, -4.0, 50.0))
    m = one(spark, camera.times(r, camera.transposed(r)))
    assert m == pytest.approx([1, 0, 0, 0, 1, 0, 0, 0, 1])
    v = one(spark, camera.rotation_vector(camera.rig_rotation(lit(0.0), lit(0.0), lit(30.0))))
    assert v == pytest.approx([0, 0, math.radians(30)])
    lens = camera.intrinsics(lit("OPENCV"), F.array(*map(lit, (1000.0, 1000.0, 500.0, 400.0, 0.1, 0.0, 0.01, 0.0))))
    u, w = camera.project(lens, F.array(*map(lit, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0))), F.array(*map(lit, (0.0, 0.0, 0.0))), lit(0.1), lit(0.2), lit(1.0))
    q = 0.05
    assert one(spark, u, w) == pytest.approx((500 + 1000 * (0.1 * (1 + 0.1 * q) + 2 * 0.01 * 0.02), 400 + 1000 * (0.2 * (1 + 0.1 * q) + 0.01 * (q + 0.08))))
    assert one(spark, camera.intrinsics(lit("FISHEYE"), F.array(lit(1.0)))) is None
    vig = camera.vignette(F.array(lit(0.001), lit(0.00001)), lit(30.0), lit(40.0), lit(0.0), lit(0.0))
    assert one(spark, vig) == pytest.approx(1 / (1 + 0.05 + 0.025))


def test_indices(spark):
    b = {"NIR": F.lit(0.5), " red": F.lit(0.1), "Blue": F.lit(0.05)}
    assert one(spark, indices.compute("ndvi", b)) == pytest.approx(0.4 / 0.6)
    assert one(spark, indices.compute("EVI", b)) == pytest.approx(2.5 * 0.4 / (0.5 + 0.6 - 0.375 + 1))
    assert one(spark, indices.compute("ndvi", {"nir": F.lit(0.0), "red": F.lit(0.0)})) is None
    assert one(spark, indices.compute("ndvi", {"nir": F.lit(float("nan")), "red": F.lit(0.1)})) is None
    own = indices.IndexDef("X", "own", ("NIR",), lambda n: n * 2, 0, 1)
    assert one(spark, indices.compute(own, b)) == 1.0
    with pytest.raises(KeyError):
        indices.compute("NDRE", b)
    with pytest.raises(ValueError):
        indices.normalised_selection(["nothing"])
    assert indices.normalised_selection(["evi", "NDVI", "ndvi"]) == ["NDVI", "EVI"] and indices.available(["nir", "Red"]) == ["NDVI", "OSAVI", "SAVI"]
    assert indices.legend(["NDWI"])[0]["colors"][0] == "#8c510a"
    assert one(spark, indices.ramp_color(F.lit(2.0), 0.0, 1.0, "vegetation")) == [26, 152, 80]
