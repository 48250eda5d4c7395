"""Named queries of the engine's operators over the driver's tables, each with the SQL that gives the same rows.

A query applies the operator to a view (plans/views.py) or a table; its SQL is written from the operator's definition, not from
its plan. Values that floating sums or functions yield are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import camera, geodesy, indices, scalars
from ..operators import coverage, grids, mosaic, observations, radiometry, rays, scan, sfm, surface, water
from ..sources import exports
from . import options
from .scratch import Rounds
from .views import view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, views: tuple[str, ...] = (), name: str | None = None):
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            text = sql.strip()
            head, rest = with_views(*views) if views else "", text
            if views and text.startswith("WITH RECURSIVE"):
                head, rest = head.replace("WITH", "WITH RECURSIVE", 1) + ",\n", text[14:].lstrip()
            elif views:
                head, rest = (head + ",\n", text[4:].lstrip()) if text.startswith("WITH") else (head + "\n", text)
            SQL[key] = head + rest
        return f

    return add


def _nadir_r() -> Column:
    """Rotation of a camera that looks straight down, its upper edge to the north."""
    return F.array(*(F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, -1.0)))


def _lens() -> Column:
    return camera.intrinsics(F.lit("PINHOLE"), F.array(F.lit(3000.0), F.lit(3000.0), F.lit(2000.0), F.lit(1500.0)))


def rounded(df: DataFrame, digits: int = 6, *names: str) -> DataFrame:
    """Doubles (or the named columns) rounded, without negative zeros."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if (c in names if names else t == "double") else F.col(c) for c, t in df.dtypes))


# ---- scans ----


@query("SELECT file, CASE WHEN lat IS NULL OR lon IS NULL THEN 'no_gps,' ELSE '' END || CASE WHEN gimbal_pitch > -70 THEN 'oblique,' ELSE '' END AS flags FROM shots", ("shots",))
def flags_list(spark, sf_dir):
    shots = scan.with_flags(view(spark, sf_dir, "shots"))
    return shots.select("file", F.concat_ws("", F.transform("flags", lambda x: F.concat(x, F.lit(",")))).alias("flags"))


@query("SELECT file, nullif(regexp_extract(file, '_([A-Z])[.]JPG$', 1), '') AS suffix, lower(file) LIKE '%.jpg' AS photo FROM shots", ("shots",))
def file_suffix(spark, sf_dir):
    return view(spark, sf_dir, "shots").select("file", scalars.suffix(F.col("file")).alias("suffix"), scalars.is_photo(F.col("file")).alias("photo"))


@query("SELECT survey, camera_key, arg_min(make, file) AS make, arg_min(model, file) AS model, arg_min(focal_mm, file) AS focal_mm, arg_min(focal_35mm, file) FILTER (focal_35mm IS NOT NULL OR true) AS focal_35mm, arg_min(width, file) AS width, arg_min(height, file) AS height, count(*) AS count FROM (SELECT survey, camera_key, make, model, focal_mm, coalesce(focal_35mm, -1) AS focal_35mm, width, height, file FROM shots) GROUP BY survey, camera_key", ("shots",))
def camera_groups(spark, sf_dir):
    return scan.camera_groups(view(spark, sf_dir, "shots").withColumn("focal_35mm", F.coalesce("focal_35mm", F.lit(-1.0))))


@query(
    """WITH c AS (SELECT survey, make, model, camera_key, min(CASE WHEN file LIKE '%_W.JPG' THEN 0 ELSE 1 END) AS rank, coalesce(min(coalesce(focal_35mm, focal_mm)), 'inf'::DOUBLE) AS focal, min(file) AS first FROM shots GROUP BY ALL)
SELECT survey, camera_key, row_number() OVER (PARTITION BY survey, make, model ORDER BY rank, focal, first) = 1 AS kept FROM c""",
    ("shots",),
)
def select_cameras(spark, sf_dir):
    return scan.select_mapping_cameras(view(spark, sf_dir, "shots")).select("survey", "camera_key", "kept")


@query(
    """WITH a AS (SELECT survey, model, camera_key, min(CASE WHEN file LIKE '%_W.JPG' THEN 0 ELSE 1 END) AS rank, min(coalesce(focal_35mm, focal_mm)) AS focal, min(file) AS first FROM shots GROUP BY survey, model, camera_key),
c AS (SELECT survey, camera_key, row_number() OVER (PARTITION BY survey, model ORDER BY rank, focal, first) = 1 AS kept FROM a),
s AS (SELECT shots.*, shots.selected AND kept AS chosen FROM shots JOIN c USING (survey, camera_key))
SELECT survey, count(*) AS total_files, count(*) FILTER (chosen) AS selected, count(*) FILTER (chosen AND (lat IS NULL OR lon IS NULL)) AS no_gps, count(*) FILTER (chosen AND gimbal_pitch > -70) AS oblique,
  count(*) FILTER (chosen AND rtk_flag = 50) AS rtk_fixed, coalesce(bool_or(chosen AND upper(model) IN ('L1D-20C', 'FC2204')), false) AS rolling_shutter_warning FROM s GROUP BY survey""",
    ("shots",),
)
def scan_summary(spark, sf_dir):
    return scan.scan_summary(scan.with_selection(scan.with_flags(view(spark, sf_dir, "shots"))))


@query("SELECT survey, file, coalesce(lon, -999) AS lon, coalesce(lat, -999) AS lat, coalesce(abs_alt, rel_alt, 0) AS alt FROM shots WHERE selected", ("shots",))
def positions(spark, sf_dir):
    return scan.positions(view(spark, sf_dir, "shots")).withColumns({c: F.nanvl(c, F.lit(-999.0)) for c in ("lon", "lat")})


@query(
    """WITH g AS (SELECT survey, capture, list_sort(list(DISTINCT rig_index)) AS s, bool_or(panel) AS panel FROM captures GROUP BY ALL),
f AS (SELECT survey, s AS fullset, row_number() OVER (PARTITION BY survey ORDER BY count(*) DESC, min(capture)) AS rn FROM g GROUP BY survey, s)
SELECT g.survey, capture, panel, len(list_intersect(s, fullset)) = len(fullset) AS complete FROM g JOIN f ON f.survey = g.survey AND rn = 1""",
    ("captures",),
)
def classify_captures(spark, sf_dir):
    return scan.classify_captures(view(spark, sf_dir, "captures"))


@query("SELECT survey, arg_min(rig_index, (CASE WHEN lower(band) = 'panchro' THEN -1 ELSE abs(wavelength - 560) END) * 100 + rig_index) AS reference FROM captures GROUP BY survey", ("captures",))
def reference_bands(spark, sf_dir):
    return scan.reference_bands(view(spark, sf_dir, "captures"))


@query(
    """WITH g AS (SELECT survey, capture, list_sort(list(DISTINCT rig_index)) AS s, bool_or(panel) AS panel FROM captures GROUP BY ALL),
f AS (SELECT survey, s AS fullset, row_number() OVER (PARTITION BY survey ORDER BY count(*) DESC, min(capture)) AS rn FROM g GROUP BY survey, s)
SELECT g.survey, capture FROM g JOIN f ON f.survey = g.survey AND rn = 1 WHERE NOT panel AND len(list_intersect(s, fullset)) = len(fullset)""",
    ("captures",),
)
def flight_captures(spark, sf_dir):
    return scan.flight_captures(view(spark, sf_dir, "captures"))


# ---- geodesy and angles ----


@query("SELECT event_id, CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + CAST(floor((lon + 180) / 6) AS INTEGER) % 60 + 1 AS epsg FROM (SELECT event_id, (event_id * 37 % 3600) * 1e-1 - 18e1 AS lon, (event_id * 11 % 160) - 8e1 AS lat FROM events)")
def utm_zone(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", geodesy.utm_epsg((F.col("event_id") * 37 % 3600) * 0.1 - 180.0, (F.col("event_id") * 11 % 160) - 80.0).cast("int").alias("epsg"))


def _tm_sql(epsg: int) -> str:
    """Forward transverse Mercator of lon, lat, written out from the series."""
    c = geodesy.crs(epsg)
    e, r = c.ellipsoid.e, c.scale * c.ellipsoid.radius
    alpha = geodesy.series(geodesy.FORWARD_SERIES, c.ellipsoid.n)
    x = " + ".join(f"({a!r}) * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(alpha, 1))
    y = " + ".join(f"({a!r}) * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(alpha, 1))
    return f"""WITH t AS (SELECT file, lon, lat, sinh(atanh(sin(radians(lat))) - {e!r} * atanh({e!r} * sin(radians(lat)))) AS t, radians(lon - ({c.lon0!r})) AS d FROM shots WHERE lon IS NOT NULL),
u AS (SELECT file, lon, lat, atan2(t, cos(d)) AS xi, atanh(sin(d) / sqrt(1 + t * t)) AS eta FROM t)
SELECT file, round({c.east!r} + {r!r} * (eta + {x}), 4) AS x, round({c.north - geodesy._meridian(c)!r} + {r!r} * (xi + {y}), 4) AS y"""


@query(_tm_sql(5186) + " FROM u", ("shots",))
def tm_forward(spark, sf_dir):
    s = view(spark, sf_dir, "shots").filter("lon is not null")
    x, y = geodesy.forward(F.col("lon"), F.col("lat"), 5186)
    return rounded(s.select("file", x.alias("x"), y.alias("y")), 4)


@query("SELECT file, round(lon, 9) AS lon, round(lat, 9) AS lat FROM shots WHERE lon IS NOT NULL", ("shots",))
def tm_inverse(spark, sf_dir):
    s = view(spark, sf_dir, "shots").filter("lon is not null")
    x, y = geodesy.forward(F.col("lon"), F.col("lat"), 32652)
    lon, lat = geodesy.inverse(x, y, 32652)
    return rounded(s.select("file", lon.alias("lon"), lat.alias("lat")), 9)


@query("SELECT file, round(2 * 6371.0 * asin(sqrt(pow(sin(radians(37.5 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(37.5)) * pow(sin(radians(127.1 - lon) / 2), 2))), 6) AS km FROM shots WHERE lon IS NOT NULL", ("shots",))
def haversine(spark, sf_dir):
    s = view(spark, sf_dir, "shots").filter("lon is not null")
    return rounded(s.select("file", geodesy.haversine_km(F.col("lon"), F.col("lat"), F.lit(127.1), F.lit(37.5)).alias("km")))


@query("SELECT event_id, a - 360 * floor((a + 180) / 360) AS wrapped FROM (SELECT event_id, (event_id * 47 % 2000) - 1e3 AS a FROM events)")
def wrap_angle(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", scalars.wrap_angle((F.col("event_id") * 47 % 2000) - 1000.0).alias("wrapped"))


_OFFSET = """d AS (SELECT survey, gimbal_yaw - flight_yaw - 360 * floor((gimbal_yaw - flight_yaw + 180) / 360) AS d FROM shots WHERE gimbal_yaw IS NOT NULL AND flight_yaw IS NOT NULL),
m AS (SELECT survey, median(d) AS m, count(*) AS k FROM d GROUP BY survey),
o AS (SELECT survey, CASE WHEN any_value(k) >= 3 AND abs(any_value(m)) >= 5 AND quantile_cont(w, 0.75) - quantile_cont(w, 0.25) <= 5 THEN any_value(m) END AS yaw_offset
  FROM (SELECT survey, m, k, d - m - 360 * floor((d - m + 180) / 360) AS w FROM d JOIN m USING (survey)) GROUP BY survey)"""


@query(f"WITH {_OFFSET} SELECT * FROM o", ("shots",))
def gimbal_offset(spark, sf_dir):
    return coverage.gimbal_offset(view(spark, sf_dir, "shots"))


_TRACK = """k AS (SELECT *, coalesce(lead(e) OVER w, e) - coalesce(lag(e) OVER w, e) AS de, coalesce(lead(n) OVER w, n) - coalesce(lag(n) OVER w, n) AS dn FROM shots WINDOW w AS (PARTITION BY survey ORDER BY coalesce(datetime, ''), file))"""


@query(f"WITH {_TRACK} SELECT survey, file, round(CASE WHEN de = 0 AND dn = 0 THEN 0 ELSE degrees(atan2(de, dn)) END, 6) AS track FROM k", ("shots",))
def track_yaw(spark, sf_dir):
    return rounded(coverage.track_yaw(view(spark, sf_dir, "shots")).select("survey", "file", "track"))


@query(
    f"""WITH {_TRACK}, {_OFFSET},
h AS (SELECT *, min(CASE WHEN rel_alt IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY survey) AS every, min(coalesce(abs_alt, 0)) OVER (PARTITION BY survey) AS low FROM k)
SELECT survey, file, round(greatest(5, CASE WHEN every = 1 THEN rel_alt ELSE coalesce(abs_alt, 0) - low + 50 END), 6) AS h, round(coalesce(gimbal_yaw - coalesce(yaw_offset, 0), CASE WHEN de = 0 AND dn = 0 THEN 0 ELSE degrees(atan2(de, dn)) END), 6) AS yaw,
  coalesce(gimbal_pitch, -90) AS pitch, round(coalesce(focal_35mm, 24) / 43.27 * sqrt(width * width + height * height), 6) AS focal, gimbal_yaw IS NULL AS yaw_assumed, focal_35mm IS NULL AS focal_assumed
FROM h LEFT JOIN o USING (survey)""",
    ("shots",),
)
def pose_impute(spark, sf_dir):
    return rounded(coverage.build_poses(view(spark, sf_dir, "shots")).select("survey", "file", "h", "yaw", "pitch", "focal", "yaw_assumed", "focal_assumed"))


@query(
    """WITH a AS (SELECT file, radians(gimbal_pitch + 90) AS t, radians(gimbal_yaw) AS w FROM shots WHERE gimbal_pitch IS NOT NULL AND gimbal_yaw IS NOT NULL)
SELECT file, round(cos(w), 9) + 0.0 AS x0, round(-sin(w), 9) + 0.0 AS x1, round(-sin(w) * cos(t), 9) + 0.0 AS y0, round(-cos(w) * cos(t), 9) + 0.0 AS y1, round(-sin(t), 9) + 0.0 AS y2, round(sin(w) * sin(t), 9) + 0.0 AS z0, round(cos(w) * sin(t), 9) + 0.0 AS z1, round(-cos(t), 9) + 0.0 AS z2 FROM a""",
    ("shots",),
)
def camera_axes(spark, sf_dir):
    s = view(spark, sf_dir, "shots").filter("gimbal_pitch is not null and gimbal_yaw is not null")
    a = camera.camera_axes(F.col("gimbal_yaw"), F.col("gimbal_pitch"))
    zero = lambda c: F.round(c, 9) + 0.0  # noqa: E731  no negative zero
    return s.select("file", *(zero(a[k][i]).alias(f"{k}{i}") for k, i in (("x", 0), ("x", 1), ("y", 0), ("y", 1), ("y", 2), ("z", 0), ("z", 1), ("z", 2))))


def _nadir(spark, sf_dir) -> DataFrame:
    """Poses that look straight down at right angles to the axes, so that footprints are boxes."""
    return view(spark, sf_dir, "shots").select("survey", "file", "datetime", "e", "n", (F.col("event_id") % 40 + 20.0).alias("h"), ((F.col("event_id") % 4) * 90.0).alias("yaw"), F.lit(-90.0).alias("pitch"), "width", "height", F.lit(3000.0).alias("focal"))


_BOXES = """b AS (SELECT survey, file, e, n, (event_id % 40 + 20) * CASE WHEN event_id % 2 = 0 THEN width ELSE height END / 6e3 AS rx, (event_id % 40 + 20) * CASE WHEN event_id % 2 = 0 THEN height ELSE width END / 6e3 AS ry FROM shots)"""


@query(f"WITH {_BOXES} SELECT survey, file, round(e - rx, 6) AS x0, round(n - ry, 6) AS y0, round(e + rx, 6) AS x1, round(n + ry, 6) AS y1 FROM b", ("shots",))
def footprint_bbox(spark, sf_dir):
    return rounded(coverage.footprints(_nadir(spark, sf_dir)).select("survey", "file", "x0", "y0", "x1", "y1"))


_CELLS = f"""{_BOXES}, c AS (SELECT survey, u.c AS col, v.r AS row FROM b, unnest(range(CAST(greatest(0, ceil((e - rx + 100) / 10 - 0.5 - 1e-9)) AS BIGINT), CAST(floor((e + rx + 100) / 10 - 0.5 + 1e-9) AS BIGINT) + 1)) u(c),
  unnest(range(CAST(greatest(0, ceil((1800 - n - ry) / 10 - 0.5 - 1e-9)) AS BIGINT), CAST(floor((1800 - n + ry) / 10 - 0.5 + 1e-9) AS BIGINT) + 1)) v(r)),
g AS (SELECT survey, row, col, count(*) AS n FROM c GROUP BY ALL)"""


def _grid(spark, sf_dir, exact=False, counted=coverage.coverage_grid):
    prints = coverage.footprints(_nadir(spark, sf_dir))
    # boxes a hair wider, so that cells whose centre is on an edge count on both sides
    prints = prints.withColumns({"x0": F.col("x0") - 1e-8, "y0": F.col("y0") - 1e-8, "x1": F.col("x1") + 1e-8, "y1": F.col("y1") + 1e-8})
    bounds = prints.select("survey").distinct().select("survey", F.lit(-100.0).alias("xmin"), F.lit(1800.0).alias("ymax"), F.lit(10.0).alias("cell"))
    return counted(prints, bounds, exact)


@query(f"WITH {_CELLS} SELECT survey, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, n FROM g", ("shots",))
def coverage_count(spark, sf_dir):
    return _grid(spark, sf_dir)


_BORDER = ", ".join(f"{{'i': {i}, 'p': {p}e0, 'q': {q}e0}}" for i, (p, q) in enumerate([*((k / 4, 0) for k in range(5)), *((1, k / 4) for k in range(5)), *((1 - k / 4, 1) for k in range(5)), *((0, 1 - k / 4) for k in range(5))]))
_POSES = f"""{_TRACK}, {_OFFSET},
h AS (SELECT *, min(CASE WHEN rel_alt IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY survey) AS every, min(coalesce(abs_alt, 0)) OVER (PARTITION BY survey) AS lowest FROM k),
p AS (SELECT survey, file, datetime, e, n, CASE WHEN every = 1 THEN rel_alt ELSE coalesce(abs_alt, 0) - lowest + 50 END AS over, coalesce(gimbal_yaw - coalesce(yaw_offset, 0), CASE WHEN de = 0 AND dn = 0 THEN 0 ELSE degrees(atan2(de, dn)) END) AS yaw,
  coalesce(gimbal_pitch, -90) AS pitch, coalesce(focal_35mm, 24) / 43.27 * sqrt(width * width + height * height) AS focal, width, height, every, yaw_offset, gimbal_yaw, focal_35mm FROM h LEFT JOIN o USING (survey))"""


@query(
    f"""WITH {_POSES},
ang AS (SELECT survey, file, e, n, greatest(5, over) AS h, width, height, focal, cos(radians(pitch + 90)) AS ct, sin(radians(pitch + 90)) AS st, cos(radians(yaw)) AS cy, sin(radians(yaw)) AS sy, unnest([{_BORDER}]) AS b FROM p),
f AS (SELECT *, b.i AS i, (width * b.p - width / 2e0) / focal AS fx, (height * b.q - height / 2e0) / focal AS fy FROM ang),
dirs AS (SELECT *, fx * cy - fy * sy * ct + sy * st AS d0, -fx * sy - fy * cy * ct + cy * st AS d1, least(-fy * st - ct, -1e-3) AS d2 FROM f),
g AS (SELECT *, h / -d2 * d0 AS gx, h / -d2 * d1 AS gy FROM dirs),
v AS (SELECT survey, file, i, e + gx * least(1, 4 * h / greatest(sqrt(gx * gx + gy * gy), 1e-12)) AS x, n + gy * least(1, 4 * h / greatest(sqrt(gx * gx + gy * gy), 1e-12)) AS y FROM g),
s AS (SELECT survey, min(x) AS xmin, max(y) AS ymax, greatest(max(x) - min(x), max(y) - min(y)) / 64 AS cell FROM v GROUP BY survey),
t AS (SELECT v.survey, v.file, v.x AS ax, v.y AS ay, w.x AS bx, w.y AS ey, xmin, ymax, cell FROM v JOIN v w ON w.survey = v.survey AND w.file = v.file AND w.i = (v.i + 1) % 20 JOIN s ON s.survey = v.survey),
c AS (SELECT *, unnest(range(greatest(0, CAST(floor((ymax - greatest(ay, ey)) / cell) AS BIGINT) - 1), CAST(ceil((ymax - least(ay, ey)) / cell) AS BIGINT) + 1)) AS row FROM t),
x AS (SELECT survey, file, row, xmin, cell, (bx - ax) * (ymax - (row + 0.5) * cell - ay) / (ey - ay) + ax AS x FROM c WHERE (ay > ymax - (row + 0.5) * cell) <> (ey > ymax - (row + 0.5) * cell)),
o2 AS (SELECT *, row_number() OVER (PARTITION BY survey, file, row ORDER BY x) AS k, lead(x) OVER (PARTITION BY survey, file, row ORDER BY x) AS x2 FROM x),
z AS (SELECT survey, row, unnest(range(greatest(0, CAST(ceil((x - xmin) / cell - 0.5) AS BIGINT)), CAST(ceil((x2 - xmin) / cell - 0.5) AS BIGINT))) AS col FROM o2 WHERE k % 2 = 1)
SELECT survey, row::INTEGER AS row, col::INTEGER AS col, count(*) AS n FROM z GROUP BY ALL""",
    ("shots",),
)
def coverage_polygons(spark, sf_dir):
    prints = coverage.footprints(coverage.build_poses(view(spark, sf_dir, "shots")))
    return coverage.coverage_grid(prints, coverage.survey_bounds(prints, 64), True)


@query(f"WITH {_CELLS} SELECT survey, count(*) * 1e2 AS survey_area_m2, 0e0 AS gap_area_m2, count(*) FILTER (n < 2 AND row % 3 <> 0) * 1e2 AS low_overlap_area_m2, median(n) AS overlap_median, quantile_cont(n, 0.1) AS overlap_p10 FROM g GROUP BY survey", ("shots",))
def coverage_stats(spark, sf_dir):
    return coverage.coverage_stats(_grid(spark, sf_dir).withColumns({"interior": F.col("row") % 3 != 0, "cell": F.lit(10.0)}))


@query(f"WITH {_CELLS} SELECT survey, row::INTEGER AS row, col::INTEGER AS col, CASE WHEN n >= 5 THEN 60 WHEN n >= 3 THEN 230 WHEN n = 2 THEN 240 ELSE 220 END AS red, CASE WHEN n >= 5 THEN 170 WHEN n >= 3 THEN 200 WHEN n = 2 THEN 140 ELSE 50 END AS green FROM g", ("shots",))
def coverage_palette(spark, sf_dir):
    c = coverage.coverage_color(F.col("n"), F.lit(False))
    return _grid(spark, sf_dir).select("survey", "row", "col", c[0].alias("red"), c[1].alias("green"))


@query()
def coverage_gaps(spark, sf_dir):
    """Areas, gaps and low overlap of whole survey areas, holes and bridged gaps included."""
    spans = _grid(spark, sf_dir, counted=coverage.coverage_spans).withColumn("cell", F.lit(10.0))
    return coverage.coverage_stats(grids.area_counts(spans, 60.0, 20.0))


@query()
def forward_overlap(spark, sf_dir):
    return coverage.forward_overlap(coverage.footprints(coverage.build_poses(view(spark, sf_dir, "shots"))))


@query(
    f"""WITH {_BOXES}, q AS (SELECT b.*, coalesce(datetime, '') AS d FROM b JOIN shots USING (survey, file)),
l AS (SELECT survey, file, rx, ry, lead(e) OVER w IS NOT NULL AS more, least(e + rx, lead(e + rx) OVER w) - greatest(e - rx, lead(e - rx) OVER w) AS dx, least(n + ry, lead(n + ry) OVER w) - greatest(n - ry, lead(n - ry) OVER w) AS dy FROM q WINDOW w AS (PARTITION BY survey ORDER BY d, file))
SELECT survey, file, round(greatest(0, dx) * greatest(0, dy) / (4 * rx * ry), 7) AS overlap FROM l WHERE more""",
    ("shots",),
)
def forward_overlap_boxes(spark, sf_dir):
    return rounded(coverage.forward_overlap(coverage.footprints(_nadir(spark, sf_dir))), 7)


@query(
    f"""WITH {_POSES}, g AS (SELECT survey, min(every) AS every, bool_or(over < 5) AS low, max(yaw_offset) AS off, count(*) FILTER (gimbal_yaw IS NULL) AS yaws, count(*) FILTER (focal_35mm IS NULL) AS focals FROM p GROUP BY survey)
SELECT survey, concat_ws('; ', CASE WHEN every = 0 THEN 'no relative heights: flying height assumed, footprints may be off in size' END, CASE WHEN low THEN 'heights under 5 m: footprints may be off' END,
  CASE WHEN off IS NOT NULL THEN 'gimbal yaw corrected by ' || CAST(round(off) AS INTEGER) || ' degrees' END, CASE WHEN yaws > 0 THEN 'yaw from the track: ' || yaws END, CASE WHEN focals > 0 THEN 'focal length assumed: ' || focals END,
  CASE WHEN survey % 2 = 1 THEN 'gaps: ' || survey || ' of ' || survey * 12 || ' square metres' END) AS warnings FROM g""",
    ("shots",),
)
def pose_warnings(spark, sf_dir):
    poses = coverage.build_poses(view(spark, sf_dir, "shots"))
    gaps = poses.select("survey").distinct().filter("survey % 2 = 1").select("survey", F.col("survey").alias("n"), (F.col("survey") * 12.0 + 0.25).alias("area_m2"))
    return coverage.warnings(poses, gaps).select("survey", F.concat_ws("; ", "warnings").alias("warnings"))


# ---- observations ----


@query(
    "SELECT point_id, image_id, p2d_idx, l_orderkey, round(sqrt(pow(l_discount * 10, 2) + pow(l_tax * 10, 2)), 5) AS err FROM (SELECT l_partkey AS point_id, l_suppkey AS image_id, l_linenumber AS p2d_idx, l_orderkey, l_discount, l_tax FROM lineitem)",
)
def obs_reproj_error(spark, sf_dir):
    nadir = F.array(*(F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, -1.0)))
    images = view(spark, sf_dir, "posed").select("image_id", "camera_id", nadir.alias("r"), F.array(-F.col("cx"), F.col("cy"), F.col("cz")).alias("t"))
    lens = camera.intrinsics(F.lit("PINHOLE"), F.array(F.lit(3000.0), F.lit(3000.0), F.lit(2000.0), F.lit(1500.0)))
    cameras = images.select("camera_id").distinct().withColumn("lens", lens)
    o = view(spark, sf_dir, "measured").withColumn("p2d_idx", F.struct("p2d_idx", "l_orderkey"))
    out = observations.observation_errors(o, view(spark, sf_dir, "cloud").select("point_id", "x", "y", "z"), images, cameras)
    return rounded(out.select("point_id", "image_id", F.col("p2d_idx.p2d_idx").alias("p2d_idx"), F.col("p2d_idx.l_orderkey").alias("l_orderkey"), "err"), 5)


@query("SELECT count(DISTINCT point_id) AS num_points, count(*) AS num_observations, round(avg(err), 6) AS mean_px, round(sqrt(avg(err * err)), 6) AS rmse_px, round(quantile_cont(err, 0.95), 6) AS p95_px, round(max(err), 6) AS max_px FROM errors WHERE point_id % 7 <> 0", ("errors",))
def reproj_stats(spark, sf_dir):
    e = view(spark, sf_dir, "errors")
    return rounded(observations.reproj_stats(e, exclude=e.filter("point_id % 7 = 0")))


@query("SELECT image_id, count(DISTINCT point_id) AS num_points, count(*) AS num_observations, round(avg(err), 6) AS mean_px, round(sqrt(avg(err * err)), 6) AS rmse_px, round(quantile_cont(err, 0.95), 6) AS p95_px, round(max(err), 6) AS max_px FROM errors GROUP BY image_id", ("errors",))
def reproj_stats_by_image(spark, sf_dir):
    return rounded(observations.reproj_stats(view(spark, sf_dir, "errors"), by=["image_id"]))


@query("WITH k AS (SELECT * FROM errors WHERE err <= 1.5 OR point_id % 11 = 0) SELECT point_id, image_id, p2d_idx, l_orderkey, round(err, 6) AS err FROM k QUALIFY count(*) OVER (PARTITION BY point_id) >= 2", ("errors",))
def filter_large_errors(spark, sf_dir):
    e = view(spark, sf_dir, "errors")
    return rounded(observations.filter_large_errors(e, 1.5, protect=e.filter("point_id % 11 = 0")).select("point_id", "image_id", "p2d_idx", "l_orderkey", "err"))


@query("SELECT CAST(sum(least(bad, greatest(track - 1, 1))) AS BIGINT) AS removed FROM (SELECT count(*) FILTER (err > 1.5) AS bad, count(*) AS track FROM errors GROUP BY point_id)", ("errors",))
def removed_count(spark, sf_dir):
    return observations.removed_count(view(spark, sf_dir, "errors"), 1.5)


@query("SELECT point_id, round(sqrt(avg(err * err)), 6) AS error_px, round(max(err), 6) AS max_px, count(*) AS track FROM errors GROUP BY point_id", ("errors",))
def point_errors(spark, sf_dir):
    return rounded(observations.point_errors(view(spark, sf_dir, "errors")))


@query("WITH p AS (SELECT point_id, round(sqrt(avg(err * err)), 9) AS error_px, count(*) AS track FROM errors GROUP BY point_id) SELECT point_id, round(error_px, 6) AS error_px, track FROM p ORDER BY p.error_px DESC, point_id LIMIT 300", ("errors",))
def tiepoint_worst(spark, sf_dir):
    worst = observations.point_errors(view(spark, sf_dir, "errors")).withColumn("error_px", F.round("error_px", 9)).orderBy(F.desc("error_px"), "point_id").limit(300)
    return rounded(worst.select("point_id", "error_px", "track"))


@query("SELECT image_id, count(err) AS num_obs, round(sqrt(avg(err * err)), 6) AS rmse_px FROM (SELECT s_suppkey AS image_id FROM supplier) LEFT JOIN (SELECT * FROM errors WHERE image_id % 10 <> 3) USING (image_id) GROUP BY image_id", ("errors",))
def tiepoint_per_image(spark, sf_dir):
    return rounded(observations.per_image(view(spark, sf_dir, "errors").filter("image_id % 10 <> 3"), view(spark, sf_dir, "posed")))


_SWEEP = "SELECT t AS threshold_px, count(*) FILTER (err > t) AS removed_obs, round(count(*) FILTER (err > t) / count(*), 9) AS removed_ratio, round(coalesce(sqrt(avg(err * err) FILTER (err <= t)), 0), 6) AS rmse_px_after FROM errors, unnest([0.5e0, 0.75e0, 1e0, 1.25e0, 1.5e0, 2e0, 2.5e0, 3e0, 4e0, 5e0]) u(t) WHERE point_id % 13 <> 0 GROUP BY t"


@query(_SWEEP, ("errors",))
def threshold_sweep(spark, sf_dir):
    e = view(spark, sf_dir, "errors")
    return observations.threshold_sweep(e, e.filter("point_id % 13 = 0")).select("threshold_px", "removed_obs", F.round("removed_ratio", 9).alias("removed_ratio"), F.round("rmse_px_after", 6).alias("rmse_px_after"))


@query(f"WITH s AS ({_SWEEP}) SELECT coalesce(min(threshold_px) FILTER (removed_ratio <= 0.1), max(threshold_px)) AS recommended_px FROM s", ("errors",))
def recommended_threshold(spark, sf_dir):
    return observations.recommended_threshold(threshold_sweep(spark, sf_dir))


@query("SELECT b::INTEGER AS bin, b * 25e-2 AS low, count(err) AS count FROM range(21) r(b) LEFT JOIN errors ON least(floor(err / 0.25), 20) = b GROUP BY b", ("errors",))
def err_histogram(spark, sf_dir):
    return observations.error_histogram(view(spark, sf_dir, "errors"))


@query(
    """WITH p AS (SELECT point_id, sqrt(avg(err * err)) AS error_px, max(err) AS max_px, count(*) AS track FROM errors GROUP BY point_id),
w AS (SELECT * FROM p ORDER BY round(error_px, 9) DESC, point_id LIMIT 50), r AS (SELECT * FROM p ANTI JOIN w USING (point_id) ORDER BY md5('0:' || point_id), point_id LIMIT 450)
SELECT point_id, round(error_px, 6) AS error_px, round(max_px, 6) AS max_px, track FROM (SELECT * FROM w UNION ALL SELECT * FROM r)""",
    ("errors",),
)
def map_points(spark, sf_dir):
    return rounded(observations.map_points(view(spark, sf_dir, "errors"), top=50, most=500))


@query(
    """WITH m AS (SELECT marks.*, p.image_id FROM marks JOIN posed p ON p.has_pose AND (p.name = marks.image OR p.name = marks.image || '.jpg'))
SELECT gcp, image_id, ordinal FROM m QUALIFY row_number() OVER (PARTITION BY gcp, image_id ORDER BY ordinal) = 1""",
    ("marks", "posed"),
)
def resolve_marks(spark, sf_dir):
    return observations.resolve_marks(view(spark, sf_dir, "marks"), view(spark, sf_dir, "posed")).select("gcp", "image_id", "ordinal")


def _residual_table(spark, sf_dir) -> DataFrame:
    p = view(spark, sf_dir, "cloud")
    d = observations.residuals(F.col("x"), F.col("y"), F.col("z"), F.round("x", 0), F.round("y", 0), F.round("z", 0) + 0.25)
    return p.select("point_id", F.when(F.col("point_id") % 4 == 0, "check").otherwise("control").alias("role"), F.when(F.col("point_id") % 9 != 0, d).alias("d")).select("point_id", "role", "d.*")


_RESIDUALS = "d AS (SELECT point_id, CASE WHEN point_id % 4 = 0 THEN 'check' ELSE 'control' END AS role, CASE WHEN point_id % 9 <> 0 THEN x - round(x) END AS dx, CASE WHEN point_id % 9 <> 0 THEN y - round(y) END AS dy, CASE WHEN point_id % 9 <> 0 THEN z - (round(z) + 0.25) END AS dz FROM cloud)"


@query(f"WITH {_RESIDUALS} SELECT point_id, role, round(dx, 6) AS dx, round(dy, 6) AS dy, round(dz, 6) AS dz, round(sqrt(dx * dx + dy * dy), 6) AS dxy, round(sqrt(dx * dx + dy * dy + dz * dz), 6) AS d3 FROM d", ("cloud",))
def gcp_residuals(spark, sf_dir):
    return rounded(_residual_table(spark, sf_dir))


@query(f"WITH {_RESIDUALS} SELECT role, count(*) AS count, round(sqrt(avg(dx * dx)), 6) AS rmse_x, round(sqrt(avg(dy * dy)), 6) AS rmse_y, round(sqrt(avg(dz * dz)), 6) AS rmse_z, round(sqrt(avg(dx * dx + dy * dy)), 6) AS rmse_xy, round(sqrt(avg(dx * dx + dy * dy + dz * dz)), 6) AS rmse_3d FROM d WHERE dx IS NOT NULL GROUP BY role", ("cloud",))
def gcp_summary(spark, sf_dir):
    return rounded(observations.gcp_summary(_residual_table(spark, sf_dir)))


@query(
    """WITH d AS (SELECT point_id AS gcp, image_id, cx, cy, cz, (u - 2e3) / 3e3 AS a, (15e2 - v) / 3e3 AS b FROM measured JOIN posed USING (image_id)),
e AS (SELECT *, a / sqrt(a * a + b * b + 1) AS dx, b / sqrt(a * a + b * b + 1) AS dy, -1 / sqrt(a * a + b * b + 1) AS dz FROM d),
s AS (SELECT gcp, count(*) AS rays, sum(1 - dx * dx) AS axx, sum(-dx * dy) AS axy, sum(-dx * dz) AS axz, sum(1 - dy * dy) AS ayy, sum(-dy * dz) AS ayz, sum(1 - dz * dz) AS azz, sum(cx - dx * (dx * cx + dy * cy + dz * cz)) AS bx, sum(cy - dy * (dx * cx + dy * cy + dz * cz)) AS by_, sum(cz - dz * (dx * cx + dy * cy + dz * cz)) AS bz FROM e GROUP BY gcp HAVING count(DISTINCT image_id) >= 3),
t AS (SELECT *, axx * (ayy * azz - ayz * ayz) - axy * (axy * azz - ayz * axz) + axz * (axy * ayz - ayy * axz) AS det FROM s)
SELECT gcp, rays, round((bx * (ayy * azz - ayz * ayz) - axy * (by_ * azz - ayz * bz) + axz * (by_ * ayz - ayy * bz)) / det, 3) + 0.0 AS x, round((axx * (by_ * azz - ayz * bz) - bx * (axy * azz - ayz * axz) + axz * (axy * bz - by_ * axz)) / det, 3) + 0.0 AS y,
  round((axx * (ayy * bz - by_ * ayz) - axy * (axy * bz - by_ * axz) + bx * (axy * ayz - ayy * axz)) / det, 3) + 0.0 AS z FROM t""",
    ("measured", "posed"),
)
def triangulate(spark, sf_dir):
    """The points nearest to the rays of the measured pixels."""
    o = view(spark, sf_dir, "measured").join(view(spark, sf_dir, "posed").select("image_id", "cx", "cy", "cz"), "image_id")
    o = o.withColumn("d", camera.ray(_lens(), _nadir_r(), F.col("u"), F.col("v")))
    rays = o.select(F.col("point_id").alias("gcp"), "image_id", *(F.col("d")[i].alias(n) for i, n in enumerate(("dx", "dy", "dz"))), F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.col("cz").alias("oz"))
    enough = rays.groupBy("gcp").agg(F.count_distinct("image_id").alias("k")).filter("k >= 3").select("gcp")
    return rounded(observations.triangulate(rays).join(enough, "gcp", "left_semi"), 3)


@query("SELECT count(*) AS n, round(sqrt(avg(pow(x - round(x), 2) + pow(y - round(y), 2))), 6) AS rms_m FROM cloud WHERE point_id % 3 <> 0", ("cloud",))
def gps_residual(spark, sf_dir):
    c = view(spark, sf_dir, "cloud").select(F.col("point_id").alias("name"), "x", "y")
    return rounded(observations.gps_residual(c, c.filter("name % 3 <> 0").select("name", F.round("x", 0).alias("gx"), F.round("y", 0).alias("gy"))))


@query("SELECT count(*) AS n, round(avg(x), 6) AS m_sx, round(avg(z), 6) AS m_sz, round(avg(2 * y + 5), 6) AS m_tx, round(covar_pop(2 * y + 5, x), 4) AS c_tx_sx, round(covar_pop(z * 3, y), 4) AS c_tz_sy, round(var_pop(x) + var_pop(y) + var_pop(z), 4) AS variance FROM cloud", ("cloud",))
def umeyama_sums(spark, sf_dir):
    c = view(spark, sf_dir, "cloud").select(F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"), (2 * F.col("y") + 5).alias("tx"), F.col("x").alias("ty"), (F.col("z") * 3).alias("tz"))
    m = observations.mean_covariance(c)
    return m.select("n", *(F.round(k, 6).alias(k) for k in ("m_sx", "m_sz", "m_tx")), *(F.round(k, 4).alias(k) for k in ("c_tx_sx", "c_tz_sy", "variance")))


@query("SELECT point_id, round(10 - 2 * y, 6) AS x, round(20 + 2 * x, 6) AS y, round(30 + 2 * z, 6) AS z FROM cloud", ("cloud",))
def fit_similarity(spark, sf_dir):
    """A quarter turn, doubled and shifted, is found from its pairs and applied."""
    c = view(spark, sf_dir, "cloud")
    pairs = c.select(F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"), (10 - 2 * F.col("y")).alias("tx"), (20 + 2 * F.col("x")).alias("ty"), (30 + 2 * F.col("z")).alias("tz"))
    return rounded(sfm.apply_similarity(c.select("point_id", "x", "y", "z"), *sfm.fit_similarity(pairs)))


@query("SELECT point_id, x, y, z FROM cloud WHERE error <= 2 AND track >= 3", ("cloud",))
def sparse_points(spark, sf_dir):
    return observations.sparse_points(view(spark, sf_dir, "cloud")).select("point_id", "x", "y", "z")


@query("SELECT survey, model AS reconstruction FROM (SELECT survey, model, row_number() OVER (PARTITION BY survey ORDER BY count(*) DESC, model) AS rn FROM shots GROUP BY survey, model) WHERE rn = 1", ("shots",))
def largest_reconstruction(spark, sf_dir):
    return sfm.largest(view(spark, sf_dir, "shots").select("survey", F.col("model").alias("reconstruction")))


@query(
    """WITH o AS (SELECT point_id, x - cx AS p0, cy - y AS p1, cz - z AS p2, u, v FROM measured JOIN posed USING (image_id) JOIN (SELECT point_id, x, y, z FROM cloud) USING (point_id) WHERE cz - z > 0),
j AS (SELECT point_id, 3e3 / p2 AS f, p0 / p2 AS a, p1 / p2 AS b, u - (3e3 * p0 / p2 + 2e3) AS eu, v - (3e3 * p1 / p2 + 15e2) AS ev FROM o),
s AS (SELECT point_id, count(*) AS k, sum(f * f) AS xx, sum(f * f * a) AS xz, sum(f * f) AS yy, sum(-f * f * b) AS yz, sum(f * f * (a * a + b * b)) AS zz, sum(f * eu) AS bx, sum(-f * ev) AS by_, sum(f * (a * eu + b * ev)) AS bz FROM j GROUP BY point_id HAVING count(*) >= 2),
d AS (SELECT *, xx * (yy * zz - yz * yz) - xz * xz * yy AS det FROM s),
m AS (SELECT point_id, (bx * (yy * zz - yz * yz) + xz * (by_ * yz - yy * bz)) / det AS dx, (xx * (by_ * zz - yz * bz) + bx * yz * xz - xz * xz * by_) / det AS dy, (xx * (yy * bz - by_ * yz) - bx * yy * xz) / det AS dz FROM d WHERE abs(det) > 1e-9 * xx * yy * zz)
SELECT point_id, round(x + coalesce(dx, 0), 3) + 0.0 AS x, round(y + coalesce(dy, 0), 3) + 0.0 AS y, round(z + coalesce(dz, 0), 3) + 0.0 AS z FROM cloud LEFT JOIN m USING (point_id)""",
    ("measured", "posed", "cloud"),
)
def adjust_points(spark, sf_dir):
    nadir = _nadir_r()
    o = view(spark, sf_dir, "measured").join(view(spark, sf_dir, "posed"), "image_id").select("point_id", "u", "v", *(F.lit(v).alias(k) for k, v in (("fx", 3000.0), ("fy", 3000.0), ("cx", 2000.0), ("cy", 1500.0))), nadir.alias("r"), F.array(-F.col("cx"), F.col("cy"), F.col("cz")).alias("t"))
    return rounded(sfm.adjust_points(o, view(spark, sf_dir, "cloud").select("point_id", "x", "y", "z")), 3)


# ---- radiometry and indices ----

_INDEX_SQL = {
    "NDVI": "CASE WHEN abs(nir + red) > 1e-6 THEN (nir - red) / (nir + red) END",
    "NDRE": "CASE WHEN abs(nir + edge) > 1e-6 THEN (nir - edge) / (nir + edge) END",
    "GNDVI": "CASE WHEN abs(nir + green) > 1e-6 THEN (nir - green) / (nir + green) END",
    "NDWI": "CASE WHEN abs(green + nir) > 1e-6 THEN (green - nir) / (green + nir) END",
    "OSAVI": "CASE WHEN abs(nir + red + 0.16) > 1e-6 THEN (nir - red) / (nir + red + 0.16) END",
    "SAVI": "CASE WHEN abs(nir + red + 0.5) > 1e-6 THEN 1.5 * (nir - red) / (nir + red + 0.5) END",
    "EVI": "CASE WHEN abs(nir + 6 * red - 7.5 * blue + 1) > 1e-6 THEN 2.5 * (nir - red) / (nir + 6 * red - 7.5 * blue + 1) END",
    "CIre": "CASE WHEN abs(edge) > 1e-6 THEN nir / edge END - 1",
    "CIg": "CASE WHEN abs(green) > 1e-6 THEN nir / green END - 1",
}
_BANDS = {"nir": "nir", "red": "red", "green": "green", "blue": "blue", "red edge": "edge"}
_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _index(name: str):
    @query(f"SELECT {', '.join(_KEYS)}, round({_INDEX_SQL[name]}, 8) + 0.0 AS value FROM pixels", ("pixels",), name=f"index_{name.lower()}")
    def one(spark, sf_dir):
        p = view(spark, sf_dir, "pixels")
        return p.select(*_KEYS, (F.round(indices.compute(name, {k: F.col(v) for k, v in _BANDS.items()}), 8) + F.lit(0.0)).alias("value"))


for _name in indices.REGISTRY:
    _index(_name)


@query("SELECT n AS name, n IN ('NDVI', 'NDRE', 'GNDVI', 'NDWI', 'OSAVI', 'SAVI', 'CIre', 'CIg') AS available, n IN ('NDVI', 'NDRE', 'GNDVI') AS \"default\" FROM unnest(['NDVI', 'NDRE', 'GNDVI', 'NDWI', 'OSAVI', 'SAVI', 'EVI', 'CIre', 'CIg']) u(n)")
def index_available(spark, sf_dir):
    return indices.catalog(spark, ["NIR", "Red", " green", "Red edge"]).select("name", "available", "default")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_quantity * 100 - 200) * (1 / (1 + 1e-5 * r + 2e-9 * r * r)) / (1 + 1e-5 * l_linenumber / 0.01 - 2e-5 * l_linenumber) * 3e-2 / (2 * 0.01 * 65536), 9) AS radiance FROM (SELECT *, sqrt(pow(l_partkey % 1280 - 640, 2) + pow(l_suppkey * 9 - 480, 2)) AS r FROM lineitem)")
def radiance(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    vig = camera.vignette(F.array(F.lit(1e-5), F.lit(2e-9)), (F.col("l_partkey") % 1280).cast("double"), F.col("l_suppkey") * 9.0, F.lit(640.0), F.lit(480.0))
    lit = F.lit
    value = camera.radiance(F.col("l_quantity") * 100, lit(200.0), vig, F.col("l_linenumber"), lit(3e-2), lit(1e-5), lit(2e-5), lit(2.0), lit(0.01), lit(16.0))
    return t.select(*_KEYS, F.round(value, 9).alias("radiance"))


@query("SELECT survey, capture, band, count(*) AS pixels, round(avg(radiance), 12) AS mean, round(avg(CASE WHEN raw >= 0.98 * full_scale THEN 1 ELSE 0 END), 9) AS saturated, round(stddev_pop(radiance) / avg(radiance), 9) AS cv FROM panels GROUP BY ALL", ("panels",))
def panel_stats(spark, sf_dir):
    return rounded(rounded(radiometry.panel_stats(view(spark, sf_dir, "panels")), 12, "mean"), 9, "saturated", "cv")


_SMOOTH = "s AS (SELECT *, quantile_cont(irradiance, 0.5) OVER (PARTITION BY survey, band ORDER BY coalesce(datetime, ''), file ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth FROM series)"


@query(f"WITH {_SMOOTH} SELECT survey, band, file, datetime, round(smooth, 8) AS smooth FROM s", ("series",))
def irradiance_smooth(spark, sf_dir):
    return rounded(radiometry.smooth_irradiance(view(spark, sf_dir, "series")).select("survey", "band", "file", "datetime", "smooth"), 8)


@query("WITH e AS (SELECT survey, band, bool_or(irradiance IS NOT NULL) AS dls, bool_or(capture % 3 = 0 AND irradiance > 50) AS panel FROM series WHERE survey < 4 OR band > 2 GROUP BY ALL) SELECT survey, CASE WHEN bool_and(dls) AND bool_and(panel) THEN 'dls+panel' WHEN bool_and(dls) THEN 'dls' WHEN bool_and(panel) THEN 'panel' ELSE 'radiance' END AS mode FROM e GROUP BY survey", ("series",))
def radiometric_mode(spark, sf_dir):
    s = view(spark, sf_dir, "series").filter("survey < 4 or band > 2")
    return radiometry.choose_mode(s.withColumns({"panel": (F.col("capture") % 3 == 0), "albedo": F.when(F.col("irradiance") > 50, 0.5)}))


@query(
    f"""WITH {_SMOOTH}, p AS (SELECT survey, band, median(pi() * mean / irr / albedo) AS ratio, median(albedo / mean) AS direct FROM (SELECT survey, band, capture, avg(radiance) AS mean, capture % 7 + 1e0 AS irr, 5e-1 AS albedo FROM panels GROUP BY ALL) GROUP BY ALL)
SELECT s.survey, s.file, s.capture, s.band, round(CASE s.survey WHEN 0 THEN pi() / smooth / ratio WHEN 1 THEN pi() / smooth WHEN 2 THEN direct ELSE 1 END, 8) AS factor FROM s LEFT JOIN p ON p.survey = s.survey AND p.band = s.band""",
    ("series", "panels"),
)
def reflectance_factors(spark, sf_dir):
    flight = radiometry.smooth_irradiance(view(spark, sf_dir, "series")).withColumn("capture", F.struct("capture", "file"))
    panels = radiometry.panel_stats(view(spark, sf_dir, "panels")).select("survey", "band", "mean", (F.col("capture") % 7 + 1.0).alias("irradiance"), F.lit(0.5).alias("albedo"))
    modes = flight.select("survey").distinct().withColumn("mode", F.element_at(F.array(*map(F.lit, ("dls+panel", "dls", "panel", "radiance", "radiance"))), (F.col("survey") + 1).cast("int")))
    out = radiometry.reflectance_factors(flight, panels, modes)
    return rounded(out.select("survey", "capture.file", "capture.capture", "band", "factor"), 8)


@query(
    """WITH m AS (SELECT point, capture, v, avg(v) OVER (PARTITION BY point) AS m, count(*) OVER (PARTITION BY point) AS k FROM levels),
g AS (SELECT capture, sum(m - v) / (count(*) + 2) AS g FROM m WHERE k >= 2 GROUP BY capture) SELECT capture, round(g - (SELECT avg(g) FROM g), 9) AS gain FROM g""",
    ("levels",),
)
def capture_gain_round(spark, sf_dir):
    rows = radiometry.solve_capture_gains(view(spark, sf_dir, "levels"), lambda x: x, rounds=1)
    return rounded(rows, 9)


@query()
def capture_gains(spark, sf_dir):
    return radiometry.solve_capture_gains(view(spark, sf_dir, "levels"), Rounds(spark, last=1).keep)


@query(
    """WITH d AS (SELECT v - avg(v) OVER w AS x, v + capture * 1e-3 - avg(v + capture * 1e-3) OVER w AS y, count(*) OVER w AS k FROM levels WINDOW w AS (PARTITION BY point)) SELECT round(sqrt(avg(x * x)), 9) AS before, round(sqrt(avg(y * y)), 9) AS after FROM d WHERE k >= 2""",
    ("levels",),
)
def capture_inconsistency(spark, sf_dir):
    v = view(spark, sf_dir, "levels")
    return rounded(radiometry.capture_inconsistency(v, v.select("capture").distinct().withColumn("gain", F.col("capture") * 1e-3)), 9)


# ---- surfaces ----


@query(
    """WITH d AS (SELECT a.survey, a.point_id, b.point_id AS other, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist FROM cloud a JOIN cloud b ON a.survey = b.survey AND a.point_id <> b.point_id),
r AS (SELECT *, row_number() OVER (PARTITION BY survey, point_id ORDER BY dist, other) AS rn FROM d WHERE dist <= 40) SELECT survey, point_id, other, round(dist, 6) AS dist, rn::INTEGER AS rn FROM r WHERE rn <= 5""",
    ("cloud",),
)
def knn_pairs(spark, sf_dir):
    return rounded(surface.knn(view(spark, sf_dir, "cloud"), 5, 40.0))


@query(
    """WITH c AS (SELECT point_id, survey, x, y, CASE WHEN point_id % 31 = 0 THEN z + 60 ELSE z END AS z FROM cloud),
d AS (SELECT a.survey, a.point_id, b.z, row_number() OVER (PARTITION BY a.survey, a.point_id ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.point_id) AS rn FROM c a JOIN c b ON a.survey = b.survey AND a.point_id <> b.point_id),
m AS (SELECT survey, point_id, median(z) AS m FROM d WHERE rn <= 16 GROUP BY ALL), q AS (SELECT d.survey, d.point_id, any_value(m) AS m, median(abs(z - m)) AS q FROM d JOIN m USING (survey, point_id) WHERE rn <= 16 GROUP BY ALL),
n AS (SELECT survey, count(*) AS n FROM c GROUP BY survey)
SELECT c.point_id FROM c JOIN n USING (survey) LEFT JOIN q USING (survey, point_id) WHERE n <= 16 OR abs(z - m) <= 3 * (1.4826 * q + 0.05)""",
    ("cloud",),
)
def remove_z_outliers(spark, sf_dir):
    c = view(spark, sf_dir, "cloud").withColumn("z", F.when(F.col("point_id") % 31 == 0, F.col("z") + 60).otherwise(F.col("z")))
    return surface.remove_z_outliers(c, Rounds(spark).keep).select("point_id")


def _raster(spark, sf_dir) -> DataFrame:
    """Embeddings as rasters of eight by eight cells."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("survey"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "z")).select("survey", F.expr("cast(i div 8 as int)").alias("row"), (F.col("i") % 8).alias("col"), "z")


_RASTER = "x AS (SELECT vec_id AS survey, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS z FROM embeddings), g AS (SELECT survey, i // 8 AS row, i % 8 AS col, z FROM x)"


@query(
    f"""WITH {_RASTER}, p AS (SELECT vec_id AS survey, greatest(0, least(7, (vec_id % 19) * 5e-1 - 5e-1)) AS fx, greatest(0, least(7, (vec_id % 13) * 7e-1 - 1)) AS fy FROM embeddings)
SELECT p.survey, round(sum(z * (1 - abs(fx - col)) * (1 - abs(fy - row))), 7) AS z FROM p JOIN g ON g.survey = p.survey AND abs(fx - col) < 1 AND abs(fy - row) < 1 GROUP BY p.survey""",
)
def sample_surface(spark, sf_dir):
    cells = _raster(spark, sf_dir)
    grids = cells.select("survey").distinct().select("survey", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("res"), F.lit(8).alias("rows"), F.lit(8).alias("cols"))
    points = grids.select("survey", ((F.col("survey") % 19) * 0.5 - 0.5).alias("x"), (-((F.col("survey") % 13) * 0.7 - 1.0)).alias("y"))
    return rounded(surface.sample_surface(points, cells, grids).select("survey", "z"), 7)


@query(f"WITH {_RASTER} SELECT survey, (row // 2)::INTEGER AS row, (col // 2)::INTEGER AS col, round(avg(z), 8) AS z FROM g GROUP BY survey, row // 2, col // 2")
def overview_pyramid(spark, sf_dir):
    return rounded(surface.overview(_raster(spark, sf_dir), "z"), 8)


@query(f"WITH {_RASTER} SELECT survey, row::INTEGER AS row, col::INTEGER AS col, round(CASE WHEN (row + col) % 3 = 0 THEN survey * 1e-2 ELSE z END, 8) AS z FROM g")
def flatten(spark, sf_dir):
    cells = _raster(spark, sf_dir)
    wet = cells.filter("(row + col) % 3 = 0").select("survey", "row", "col", (F.col("survey") * 1e-2).alias("level"))
    return rounded(surface.flatten(cells, wet), 8)


@query("SELECT s_suppkey AS survey, r::INTEGER AS row, c::INTEGER AS col, s_acctbal AS z FROM supplier, range(3) a(r), range(4) b(c)")
def plane_surface(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return surface.plane_surface(s.select(F.col("s_suppkey").alias("survey"), F.lit(3).alias("rows"), F.lit(4).alias("cols"), "s_acctbal"), F.col("s_acctbal"))


@query()
def build_surface(spark, sf_dir):
    p = view(spark, sf_dir, "cloud")
    grids = p.select("survey").distinct().select("survey", F.lit(0.0).alias("x0"), F.lit(400.0).alias("y0"), F.lit(20.0).alias("res"), F.lit(21).alias("rows"), F.lit(26).alias("cols"))
    return surface.build_surface(p, grids)


# ---- mosaics ----


@query("SELECT survey, round(median(greatest(cz - (point_z), 1) / 3000), 9) AS gsd FROM (SELECT survey, cz, image_id % 5 + 1e0 AS point_z FROM posed) GROUP BY survey", ("posed",))
def native_gsd(spark, sf_dir):
    return rounded(mosaic.native_gsd(view(spark, sf_dir, "posed").select("survey", "cz", (F.col("image_id") % 5 + 1.0).alias("ground_z"), F.lit(2900.0).alias("fx"), F.lit(3100.0).alias("fy"))), 9)


@query("SELECT survey, view, tx, ty FROM frames, range(0, 30) a(tx), range(0, 30) b(ty) WHERE x0 < (tx + 1) * 25 AND x1 > tx * 25 AND y0 < (ty + 1) * 25 AND y1 > ty * 25", ("frames",))
def tile_view_join(spark, sf_dir):
    return mosaic.tiles_of_views(view(spark, sf_dir, "frames"), 25.0)


_SEAM = "w AS (SELECT *, CASE WHEN exp(-(r - min(r) OVER p) / 40e0) >= 1e-3 THEN exp(-(r - min(r) OVER p) / 40e0) ELSE 0 END AS w FROM looks WINDOW p AS (PARTITION BY survey, row, col))"


def _weighted(spark, sf_dir):
    return mosaic.with_seam_weights(view(spark, sf_dir, "looks"), F.lit(40.0))


@query(f"WITH {_SEAM} SELECT survey, row, col, view, round(r, 4) AS r, round(w, 8) AS w FROM w", ("looks",))
def seam_weights(spark, sf_dir):
    return _weighted(spark, sf_dir).select("survey", "row", "col", "view", F.round("r", 4).alias("r"), F.round("w", 8).alias("w"))


@query(f"WITH {_SEAM} SELECT survey, row, col, round(sum(w * red) / sum(w), 7) AS red, round(sum(w * green) / sum(w), 7) AS green, 255 AS alpha FROM w GROUP BY survey, row, col", ("looks",))
def seam_blend(spark, sf_dir):
    return rounded(mosaic.blend(_weighted(spark, sf_dir), ["red", "green"]), 7)


@query(f"WITH {_SEAM} SELECT survey, row, col, floor(least(255, greatest(0, round(sum(w * red) / sum(w), 9) + 0.5)))::INTEGER AS red, 255 AS alpha FROM w GROUP BY survey, row, col", ("looks",))
def seam_blend_bytes(spark, sf_dir):
    return mosaic.blend(_weighted(spark, sf_dir), ["red"], as_bytes=True)


@query(
    f"""WITH {_SEAM}, e AS (SELECT survey, row, col, mask AS band, sum(w * red) / sum(w) AS value FROM w GROUP BY ALL HAVING sum(w) > 0), n AS (SELECT survey, count(DISTINCT mask) AS n FROM looks GROUP BY survey)
SELECT survey, row, col, band, round(value, 7) AS value FROM (SELECT e.*, count(*) OVER (PARTITION BY survey, row, col) AS have FROM e) JOIN n USING (survey) WHERE have = n""",
    ("looks",),
)
def blend_bands(spark, sf_dir):
    return rounded(mosaic.blend_bands(_weighted(spark, sf_dir).withColumns({"band": F.col("mask"), "value": F.col("red")})), 7)


@query(
    f"""WITH {_SEAM} SELECT survey, row, col, view, round(ln(red + 4), 8) AS own, round(sum(w * ln(red + 4)) OVER p / sum(w) OVER p, 7) AS target, round(w / sum(w) OVER p, 7) AS share FROM w WINDOW p AS (PARTITION BY survey, row, col)""",
    ("looks",),
)
def tone_targets(spark, sf_dir):
    t = mosaic.log_targets(view(spark, sf_dir, "looks").withColumn("lum", F.col("red")), F.lit(40.0))
    return t.select("survey", "row", "col", "view", F.round("own", 8).alias("own"), F.round("target", 7).alias("target"), F.round("share", 7).alias("share"))


@query()
def tone_gains(spark, sf_dir):
    t = mosaic.log_targets(view(spark, sf_dir, "looks").withColumns({"lum": F.col("red"), "view": F.col("mask"), "nx": F.col("col") / 7.0 - 1.0, "ny": F.col("row") / 10.0 - 1.0}), F.lit(40.0))
    return mosaic.fit_gains(t)


# ---- views and rays ----

# a rotation from angles, row by row
_TURNED = """w AS (SELECT *, radians(image_id % 5 - 2) AS om, radians(image_id % 7 - 3) AS ph, radians(image_id * 40 % 360) AS ka FROM posed),
m AS (SELECT *, cos(ph) * cos(ka) AS r0, cos(om) * sin(ka) + sin(om) * sin(ph) * cos(ka) AS r1, sin(om) * sin(ka) - cos(om) * sin(ph) * cos(ka) AS r2, cos(ph) * sin(ka) AS r3, sin(om) * sin(ph) * sin(ka) - cos(om) * cos(ka) AS r4, -sin(om) * cos(ka) - cos(om) * sin(ph) * sin(ka) AS r5,
  -sin(ph) AS r6, sin(om) * cos(ph) AS r7, -cos(om) * cos(ph) AS r8 FROM w)"""


def _turned(spark, sf_dir, width: int = 4000, height: int = 3000) -> DataFrame:
    """Posed images with rotations of small tilts."""
    p = view(spark, sf_dir, "posed")
    i = F.col("image_id")
    p = p.withColumn("r", camera.rotation_from_opk(i % 5 - 2, i % 7 - 3, i * 40 % 360))
    t = F.array(*(-(F.col("r")[3 * k] * F.col("cx") + F.col("r")[3 * k + 1] * F.col("cy") + F.col("r")[3 * k + 2] * F.col("cz")) for k in range(3)))
    return p.select("survey", "image_id", F.lit(width).alias("width"), F.lit(height).alias("height"), _lens().alias("lens"), "r", t.alias("t"))


_FRAME = ", ".join(f"{{'p': {p}e0, 'q': {q}e0}}" for p, q in [*((k / 8, 0) for k in range(9)), *((1, k / 8) for k in range(9)), *((k / 8, 1) for k in range(9)), *((0, k / 8) for k in range(9))])


_VIEWS = f"""{_TURNED}, b AS (SELECT *, unnest([{_FRAME}]) AS b FROM m), f AS (SELECT *, (4e3 * b.p - 2e3) / 3e3 AS fx, (3e3 * b.q - 15e2) / 3e3 AS fy FROM b),
d AS (SELECT *, r0 * fx + r3 * fy + r6 AS dx, r1 * fx + r4 * fy + r7 AS dy, r2 * fx + r5 * fy + r8 AS dz FROM f),
g AS (SELECT *, (2e1 - cz) / dz * dx AS gx, (2e1 - cz) / dz * dy AS gy FROM d WHERE dz < -1e-6),
n AS (SELECT *, least(1, 4 * greatest(cz - 2e1, 1) / greatest(sqrt(gx * gx + gy * gy), 1e-9)) AS k FROM g),
v AS (SELECT survey, image_id, any_value(cx) AS cx, any_value(cy) AS cy, any_value(cz) AS cz, min(cx + gx * k) AS x0, min(cy + gy * k) AS y0, max(cx + gx * k) AS x1, max(cy + gy * k) AS y1 FROM n GROUP BY ALL HAVING count(*) >= 3)"""


@query(f"WITH {_VIEWS} SELECT survey, image_id, round(cx, 6) + 0.0 AS cx, round(cy, 6) + 0.0 AS cy, round(cz, 6) AS cz, round(x0, 6) + 0.0 AS x0, round(y0, 6) + 0.0 AS y0, round(x1, 6) + 0.0 AS x1, round(y1, 6) + 0.0 AS y1 FROM v", ("posed",))
def view_boxes(spark, sf_dir):
    v = rays.views(_turned(spark, sf_dir), F.lit(20.0))
    return rounded(v.select("survey", "image_id", "cx", "cy", "cz", "x0", "y0", "x1", "y1"))


_GROUND = "k AS (SELECT s AS survey, r AS row, c AS col, c * 2e1 + 1e1 AS x, r * 2e1 + 5e0 AS y, 15e0 + (r * 3 + c) % 7 AS z FROM range(4) a(s), range(21) b(r), range(26) d(c))"


def _ground(spark) -> DataFrame:
    cells = spark.range(4 * 21 * 26).select(F.expr("id div 546").alias("survey"), F.expr("cast(id % 546 div 26 as int)").alias("row"), F.expr("cast(id % 26 as int)").alias("col"))
    return cells.select("*", (F.col("col") * 20.0 + 10.0).alias("x"), (F.col("row") * 20.0 + 5.0).alias("y"), (15.0 + (F.col("row") * 3 + F.col("col")) % 7).alias("z"))


_LOOKS = f"""{_VIEWS}, {_GROUND}, a AS (SELECT k.*, v.image_id AS view, x - v.cx AS ex, y - v.cy AS ey, z - v.cz AS ez FROM k JOIN v ON v.survey = k.survey AND x0 < (floor(x / 5e1) + 1) * 5e1 AND x1 > floor(x / 5e1) * 5e1 AND y0 < (floor(y / 5e1) + 1) * 5e1 AND y1 > floor(y / 5e1) * 5e1),
c AS (SELECT a.survey, row, col, view, r0 * ex + r1 * ey + r2 * ez AS c0, r3 * ex + r4 * ey + r5 * ez AS c1, r6 * ex + r7 * ey + r8 * ez AS c2 FROM a JOIN m ON m.image_id = view),
l AS (SELECT survey, row, col, view, 3e3 * c0 / c2 + 2e3 AS u, 3e3 * c1 / c2 + 15e2 AS v FROM c WHERE c2 > 0),
seen AS (SELECT *, sqrt(pow(u - 2e3, 2) + pow(v - 15e2, 2)) AS r FROM l WHERE u >= 0.5 AND u < 3999.5 AND v >= 0.5 AND v < 2999.5)"""


@query(f"WITH {_LOOKS} SELECT survey, row::INTEGER AS row, col::INTEGER AS col, view, round(u, 5) AS u, round(v, 5) AS v, round(r, 5) AS r FROM seen", ("posed",))
def cell_looks(spark, sf_dir):
    """The pixel of every cell in every photo that shows it."""
    out = rays.looks(_ground(spark), rays.views(_turned(spark, sf_dir), F.lit(20.0)), 50.0)
    return rounded(out.select("survey", "row", "col", "view", "u", "v", "r"), 5)


def _photos(spark, sf_dir) -> DataFrame:
    """Photos of eight by eight pixels."""
    return _raster(spark, sf_dir).select((F.col("survey") % 4).alias("survey"), F.col("survey").alias("view"), F.col("row").alias("prow"), F.col("col").alias("pcol"), "z")


_SAMPLED = f"""{_LOOKS}, x AS (SELECT vec_id AS view, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS z FROM embeddings), h AS (SELECT view, i // 8 AS prow, i % 8 AS pcol, z FROM x),
q AS (SELECT *, greatest(0, least(7, u / 500 - 0.5)) AS fx, greatest(0, least(7, v / 375 - 0.5)) AS fy FROM seen),
got AS (SELECT q.survey, q.row, q.col, q.view, q.r, sum(z * (1 - abs(fx - pcol)) * (1 - abs(fy - prow))) AS z FROM q JOIN h ON h.view = q.view AND abs(fx - pcol) < 1 AND abs(fy - prow) < 1 GROUP BY ALL)"""


def _looked(spark, sf_dir) -> DataFrame:
    seen = rays.looks(_ground(spark), rays.views(_turned(spark, sf_dir), F.lit(20.0)), 50.0)
    return rays.sampled(seen, _photos(spark, sf_dir).withColumn("survey", F.col("view") % 4), ["z"])


@query(f"WITH {_SAMPLED} SELECT survey, row::INTEGER AS row, col::INTEGER AS col, view, round(z, 7) + 0.0 AS z FROM got", ("posed",))
def photo_samples(spark, sf_dir):
    return rounded(_looked(spark, sf_dir).select("survey", "row", "col", "view", "z"), 7)


@query(
    f"""WITH {_SAMPLED}, t AS (SELECT *, exp(-(r - min(r) OVER (PARTITION BY survey, row, col)) / 3e2) AS w FROM got)
SELECT survey, row::INTEGER AS row, col::INTEGER AS col, round(sum(z * w) FILTER (w >= 1e-3) / sum(w) FILTER (w >= 1e-3), 7) + 0.0 AS z, 255 AS alpha FROM t GROUP BY survey, row, col""",
    ("posed",),
)
def render_photos(spark, sf_dir):
    """A mosaic from photos: views, looks, samples, seam weights, blending."""
    return rounded(mosaic.blend(mosaic.with_seam_weights(_looked(spark, sf_dir), F.lit(300.0)), ["z"]), 7)


def _pixel_rays(spark, sf_dir) -> DataFrame:
    """Rays of the measured pixels, from tilted cameras."""
    o = view(spark, sf_dir, "measured").join(_turned(spark, sf_dir), "image_id")
    o = o.withColumns({"d": camera.ray(F.col("lens"), F.col("r"), F.col("u") - 4000.0 * F.floor(F.col("u") / 4000.0), F.col("v") - 3000.0 * F.floor(F.col("v") / 3000.0)), "c": F.array(*camera.centre(F.col("r"), F.col("t")))})
    return o.select("survey", F.struct("l_orderkey", "p2d_idx", "point_id", "image_id").alias("key"), *(F.col("c")[i].alias(n) for i, n in enumerate(("ox", "oy", "oz"))), *(F.col("d")[i].alias(n) for i, n in enumerate(("dx", "dy", "dz"))))


_RAYS = f"""{_TURNED}, o AS (SELECT survey, l_orderkey, p2d_idx, point_id, image_id, cx, cy, cz, r0, r1, r2, r3, r4, r5, r6, r7, r8, (u - 4e3 * floor(u / 4e3) - 2e3) / 3e3 AS a, (v - 3e3 * floor(v / 3e3) - 15e2) / 3e3 AS b FROM measured JOIN m USING (image_id)),
y AS (SELECT survey, l_orderkey, p2d_idx, point_id, image_id, cx, cy, cz, (r0 * a + r3 * b + r6) / sqrt(a * a + b * b + 1) AS dx, (r1 * a + r4 * b + r7) / sqrt(a * a + b * b + 1) AS dy, (r2 * a + r5 * b + r8) / sqrt(a * a + b * b + 1) AS dz FROM o)"""
_RAY_KEYS = ("l_orderkey", "p2d_idx", "point_id", "image_id")


@query(f"WITH {_RAYS} SELECT {', '.join(_RAY_KEYS)}, round(dx, 9) + 0.0 AS dx, round(dy, 9) + 0.0 AS dy, round(dz, 9) + 0.0 AS dz FROM y", ("posed", "measured"))
def pixel_rays(spark, sf_dir):
    return rounded(_pixel_rays(spark, sf_dir).select("key.*", "dx", "dy", "dz"), 9)


@query(f"WITH {_RAYS} SELECT {', '.join(_RAY_KEYS)}, CASE WHEN dz < -1e-9 THEN round(cx + (5 - cz) / dz * dx, 4) + 0.0 END AS x, CASE WHEN dz < -1e-9 THEN round(cy + (5 - cz) / dz * dy, 4) + 0.0 END AS y FROM y", ("posed", "measured"))
def pixels_on_plane(spark, sf_dir):
    r = _pixel_rays(spark, sf_dir)
    x, y, _ = camera.on_plane([F.col("ox"), F.col("oy"), F.col("oz")], F.array("dx", "dy", "dz"), F.lit(5.0))
    return rounded(r.select("key.*", x.alias("x"), y.alias("y")), 4)


def _slope(x: str, y: str) -> str:
    return f"1e1 + 2e-2 * greatest(-2e2, least(98e1, {x})) - 1e-2 * greatest(-28e1, least(7e2, {y})) + survey"


def _sloped(spark) -> tuple[DataFrame, DataFrame]:
    """A sloping surface of each survey, and its grid."""
    grids_ = spark.range(4).select(F.col("id").alias("survey"), F.lit(-200.0).alias("x0"), F.lit(700.0).alias("y0"), F.lit(20.0).alias("res"), F.lit(50).alias("rows"), F.lit(60).alias("cols"))
    cells = surface.plane_surface(grids_, F.lit(0.0))
    z = 10.0 + 0.02 * (F.col("col") * 20.0 - 200.0) - 0.01 * (700.0 - F.col("row") * 20.0) + F.col("survey")
    return cells.withColumn("z", z), grids_


@query(
    f"""WITH RECURSIVE {_RAYS}, g AS (SELECT s AS survey, median(1e1 + 2e-2 * (c * 2e1 - 2e2) - 1e-2 * (7e2 - r * 2e1) + s) AS mid FROM range(4) a(s), range(50) b(r), range(60) d(c) GROUP BY s),
q AS (SELECT y.*, 0 AS n, mid AS z, false AS done FROM y JOIN g USING (survey) WHERE dz < -1e-9
  UNION ALL SELECT survey, l_orderkey, p2d_idx, point_id, image_id, cx, cy, cz, dx, dy, dz, n + 1, CASE WHEN abs(u - z) < 5e-3 THEN u ELSE 0.5 * (z + u) END, abs(u - z) < 5e-3
    FROM (SELECT *, {_slope('cx + (z - cz) / dz * dx', 'cy + (z - cz) / dz * dy')} AS u FROM q WHERE n < 30 AND NOT done))
SELECT {', '.join(_RAY_KEYS)}, round(cx + (z - cz) / dz * dx, 3) + 0.0 AS x, round(cy + (z - cz) / dz * dy, 3) + 0.0 AS y, round(z, 3) AS z FROM q WHERE done OR n = 30""",
    ("posed", "measured"),
)
def pixels_on_surface(spark, sf_dir):
    cells, grids_ = _sloped(spark)
    r = _pixel_rays(spark, sf_dir).withColumn("ray_id", F.to_json("key"))
    out = rays.on_surface(r.drop("key"), cells, grids_)
    key = F.from_json("ray_id", "l_orderkey long, p2d_idx int, point_id long, image_id long")
    return rounded(out.filter("x is not null").select(key.alias("k"), "x", "y", "z").select("k.*", "x", "y", "z"), 3)


# ---- water ----


@query("SELECT survey, row, col, count(*) AS looks, round(avg(CASE WHEN mask > 0 THEN 1 ELSE 0 END), 9) AS share, avg(CASE WHEN mask > 0 THEN 1 ELSE 0 END) >= 0.5 AS candidate FROM looks GROUP BY ALL", ("looks",))
def cell_vote(spark, sf_dir):
    return rounded(water.cell_votes(view(spark, sf_dir, "looks")), 9)


_CLOUD_CELLS = "q AS (SELECT survey, CAST(floor(x / 25) AS INTEGER) AS col, CAST(floor(y / 25) AS INTEGER) AS row, z FROM cloud), g AS (SELECT s AS survey, r::INTEGER AS row, c::INTEGER AS col, (r * 5 + c * 3 + s) % 7 < 3 AS candidate FROM range(4) a(s), range(16) b(r), range(20) d(c))"


def _cloud_cells(spark, sf_dir):
    p = view(spark, sf_dir, "cloud").select("survey", F.floor(F.col("y") / 25).cast("int").alias("row"), F.floor(F.col("x") / 25).cast("int").alias("col"), "z")
    cells = spark.range(4 * 16 * 20).select(F.expr("id div 320").alias("survey"), F.expr("cast(id % 320 div 20 as int)").alias("row"), F.expr("cast(id % 20 as int)").alias("col"))
    return p, cells.withColumn("candidate", (F.col("row") * 5 + F.col("col") * 3 + F.col("survey")) % 7 < 3)


@query(f"WITH {_CLOUD_CELLS}, d AS (SELECT g.survey, g.row, g.col, candidate, count(z) AS points FROM g LEFT JOIN q ON q.survey = g.survey AND q.row = g.row AND q.col = g.col GROUP BY ALL) SELECT *, round(avg(points) FILTER (NOT candidate) OVER (PARTITION BY survey), 9) AS land FROM d", ("cloud",))
def point_density(spark, sf_dir):
    p, cells = _cloud_cells(spark, sf_dir)
    return rounded(water.point_density(p, cells).select("survey", "row", "col", "candidate", "points", "land"), 9)


@query(
    f"""WITH RECURSIVE {_CLOUD_CELLS}, k AS (SELECT survey, row, col, row * 100 + col AS id FROM g WHERE candidate),
j AS (SELECT a.survey, a.id AS a, b.id AS b FROM k a JOIN k b ON a.survey = b.survey AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1),
r AS (SELECT survey, a, b FROM j UNION SELECT r.survey, r.a, j.b FROM r JOIN j ON j.survey = r.survey AND j.a = r.b),
l AS (SELECT survey, a AS id, min(b) AS root FROM r GROUP BY ALL), n AS (SELECT k.survey, k.row, k.col, dense_rank() OVER (PARTITION BY k.survey ORDER BY root)::INTEGER AS label FROM k JOIN l USING (survey, id)),
d AS (SELECT g.survey, g.row, g.col, candidate, count(z) AS points FROM g LEFT JOIN q ON q.survey = g.survey AND q.row = g.row AND q.col = g.col GROUP BY ALL), e AS (SELECT survey, avg(points) AS land FROM d WHERE NOT candidate GROUP BY survey),
s AS (SELECT n.survey, label, count(*) AS cells, avg(points) AS mean, any_value(land) AS land FROM n JOIN d USING (survey, row, col) JOIN e ON e.survey = n.survey GROUP BY ALL),
h AS (SELECT DISTINCT n.survey, label, n.row + i AS row, n.col + c AS col FROM n, range(-1, 2) a(i), range(-1, 2) b(c)), o AS (SELECT * FROM h ANTI JOIN n USING (survey, row, col)),
m AS (SELECT o.survey, label, count(*) AS n_shore, quantile_cont(z, 0.25) AS level, quantile_cont(z, 0.05) AS p5, median(z) AS z_shore FROM o JOIN q USING (survey, row, col) GROUP BY ALL),
t AS (SELECT n.survey, label, count(*) AS n_in, median(z) AS z_in FROM n JOIN q USING (survey, row, col) GROUP BY ALL)
SELECT s.survey, s.label, s.cells, round(level, 6) AS level, coalesce(cells >= 4 AND mean < 0.15 * land AND coalesce(n_shore >= 5, false) AND (NOT coalesce(n_in, 0) >= greatest(10, 0.2 * n_shore) OR z_in - z_shore <= 1.5) AND level - p5 <= 3, false) AS accepted
FROM s LEFT JOIN m ON m.survey = s.survey AND m.label = s.label LEFT JOIN t ON t.survey = s.survey AND t.label = s.label""",
    ("cloud",),
)
def water_bodies(spark, sf_dir):
    p, cells = _cloud_cells(spark, sf_dir)
    labelled = water.label_cells(cells)
    return rounded(water.water_bodies(labelled, water.point_density(p, cells), p, 25.0))


@query(f"WITH {_CLOUD_CELLS}, l AS (SELECT DISTINCT survey, row, col FROM g WHERE candidate), s AS (SELECT DISTINCT l.survey, l.row + i AS row, l.col + j AS col FROM l, range(-1, 2) a(i), range(-1, 2) b(j)) SELECT survey, row::INTEGER AS row, col::INTEGER AS col FROM s ANTI JOIN l USING (survey, row, col)", ("cloud",))
def water_shore(spark, sf_dir):
    _, cells = _cloud_cells(spark, sf_dir)
    labelled = cells.filter("candidate").select("survey", F.lit(1).alias("label"), "row", "col")
    return water.shore(labelled, 4.0).select("survey", "row", "col")


@query("WITH p AS (SELECT survey, image, avg(CASE WHEN mask > 0 THEN 1 ELSE 0 END) AS f, avg(CASE WHEN mask = 2 THEN 1 ELSE 0 END) AS c FROM masks GROUP BY ALL) SELECT survey, round(avg(f), 9) AS fraction, count(*) FILTER (f > 0.01) AS images_with_water, round(avg(c), 9) AS confident_fraction FROM p GROUP BY survey", ("masks",))
def water_summary(spark, sf_dir):
    return rounded(water.summarize(view(spark, sf_dir, "masks")), 9)


@query("SELECT survey, image, v, u, CASE WHEN survey = 0 THEN mask // 100 ELSE mask END AS mask FROM masks", ("masks",))
def mask_normalise(spark, sf_dir):
    return water.normalize_masks(view(spark, sf_dir, "masks")).select("survey", "image", "v", "u", "mask")


# ---- texts and lists ----


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id * 5e-1 END AS number, CASE WHEN event_id % 3 = 0 THEN false ELSE true END AS numeric, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id * 5e-1 + 1 END AS second FROM events")
def lenient_numbers(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.col("event_id").cast("string"), F.lit("x"))).otherwise((F.col("event_id") * 0.5).cast("string"))
    both = F.concat(text, F.lit(" ,"), F.when(F.col("event_id") % 3 == 0, text).otherwise((F.col("event_id") * 0.5 + 1).cast("string")))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", scalars.to_float(text).alias("number"), scalars.is_number(text).alias("numeric"), F.try_element_at(scalars.floats(both), F.lit(2)).alias("second"))


@query("SELECT event_id, round((event_id % 180) + (event_id % 60) / 60e0 + 36 / 36e2, 9) * CASE WHEN event_id % 4 IN (1, 3) THEN -1 ELSE 1 END AS degrees FROM events")
def dms_to_degrees(spark, sf_dir):
    e = F.col("event_id")
    ref = F.element_at(F.array(*map(F.lit, ("N", " s", "E", "W"))), (e % 4 + 1).cast("int"))
    return rounded(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", scalars.dms_to_deg(e % 180, (e % 60).cast("double"), F.lit(36.0), ref).alias("degrees")), 9)


@query("SELECT event_id, event_id % 9 AS major, event_id % 100 AS minor, event_id % 7 AS patch FROM events")
def version_parts(spark, sf_dir):
    e = F.col("event_id")
    v = scalars.version_parts(F.concat(F.lit("v"), (e % 9).cast("string"), F.lit("."), (e % 100).cast("string"), F.lit("."), (e % 7).cast("string"), F.lit("-rc1")))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", *(v[i].cast("long").alias(n) for i, n in enumerate(("major", "minor", "patch"))))


@query("SELECT survey, sum(n)::BIGINT AS kinds FROM (SELECT survey, count(DISTINCT model) AS n FROM shots GROUP BY survey) GROUP BY survey", ("shots",))
def dedupe_warnings(spark, sf_dir):
    s = view(spark, sf_dir, "shots").groupBy("survey").agg(F.array_sort(F.collect_list("model")).alias("a"), F.collect_set("model").alias("b"))
    return s.select("survey", F.size(scalars.merged_warnings(F.col("a"), F.col("b"))).cast("long").alias("kinds"))


# ---- exports, pairs, samples ----


@query("SELECT image_id, printf('%s,%.4f,%.4f,%.4f,%.6f,%.6f,%.6f', name, cx, cy, cz, 0.0, 0.0, 0.0) AS line FROM posed", ("posed",))
def camera_csv(spark, sf_dir):
    p = view(spark, sf_dir, "posed")
    nadir = F.array(*(F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, -1.0)))
    return p.select("image_id", exports.camera_csv_line(F.col("name"), F.col("cx"), F.col("cy"), F.col("cz"), nadir).alias("line"))


@query("SELECT file, round(lon, 8) AS lon, round(lat, 8) AS lat FROM shots WHERE lon IS NOT NULL", ("shots",))
def raster_corner(spark, sf_dir):
    """The upper left corner of a raster that begins at a shot's projected place is the shot's place."""
    s = view(spark, sf_dir, "shots").filter("lon is not null")
    x, y = geodesy.forward(F.col("lon"), F.col("lat"), 5186)
    c = s.select("file", x.alias("x"), y.alias("y")).select("file", exports.corners_lonlat(F.col("x"), F.col("y"), F.lit(0.5), F.lit(10), F.lit(20), 5186)[0].alias("c"))
    return rounded(c.select("file", "c.lon", "c.lat"), 8)


@query(
    """WITH d AS (SELECT a.survey, a.image_id AS p, b.image_id AS q, sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)) AS dist FROM posed a JOIN posed b ON a.survey = b.survey AND a.image_id <> b.image_id),
r AS (SELECT *, row_number() OVER (PARTITION BY survey, p ORDER BY dist, q) AS rn FROM d WHERE dist <= 150)
SELECT DISTINCT survey, least(p, q) AS a, greatest(p, q) AS b FROM r WHERE rn <= 4""",
    ("posed",),
)
def spatial_pairs(spark, sf_dir):
    p = view(spark, sf_dir, "posed").select("survey", "image_id", F.col("cx").alias("x"), F.col("cy").alias("y"))
    return sfm.spatial_pairs(p, 4, 150.0)


@query(
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(0, least(1, nir * 2)) AS p FROM pixels)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(CASE WHEN p <= 0.35 THEN 140 + 76 * (p - 0) / (0.35 - 0) WHEN p <= 0.55 THEN 216 + 30 * (p - 0.35) / (0.55 - 0.35) WHEN p <= 0.7 THEN 246 - 101 * (p - 0.55) / (0.7 - 0.55) ELSE 145 - 119 * (p - 0.7) / (1 - 0.7) END + 0.5) AS INTEGER) AS red FROM p""",
    ("pixels",),
)
def index_colors(spark, sf_dir):
    p = view(spark, sf_dir, "pixels")
    return p.select(*_KEYS, indices.ramp_color(F.col("nir"), 0.0, 0.5, "vegetation")[0].alias("red"))


@query("SELECT survey, list_sort(list(DISTINCT model))[1] AS first, count(DISTINCT model) AS n FROM shots GROUP BY survey", ("shots",))
def sorted_distinct(spark, sf_dir):
    s = view(spark, sf_dir, "shots").groupBy("survey").agg(F.collect_set("model").alias("m"))
    return s.select("survey", scalars.sorted_ids(F.col("m"))[0].alias("first"), F.size("m").cast("long").alias("n"))


@query("SELECT survey, bool_or(NOT has) AS lacks FROM (SELECT s.survey, m.model, count(t.event_id) > 0 AS has FROM (SELECT DISTINCT survey FROM shots) s CROSS JOIN (SELECT DISTINCT model FROM shots) m LEFT JOIN shots t ON t.survey = s.survey AND t.model = m.model GROUP BY ALL) GROUP BY survey", ("shots",))
def lacking_models(spark, sf_dir):
    s = view(spark, sf_dir, "shots")
    full = [r.model for r in s.select("model").distinct().collect()]  # the few models of all surveys
    return s.groupBy("survey").agg(F.collect_set("model").alias("have")).select("survey", scalars.lacks(F.array(*map(F.lit, full)), F.col("have")).alias("lacks"))


@query(
    """WITH k AS (SELECT *, concat_ws(':', point_id, l_orderkey, p2d_idx) AS key FROM errors)
SELECT point_id, image_id, p2d_idx, l_orderkey, round(err, 6) AS err FROM k QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY md5('0:' || key), key) <= 20""",
    ("errors",),
)
def hashed_sample(spark, sf_dir):
    e = view(spark, sf_dir, "errors").withColumn("key", F.concat_ws(":", "point_id", "l_orderkey", "p2d_idx"))
    return rounded(observations.hashed_sample(e, "key", 20, by="image_id").drop("key"))


# ---- bands, tiles and reports ----


@query(
    """WITH b AS (SELECT *, concat('F', capture, '_', rig_index) AS file FROM captures), r AS (SELECT survey, arg_min(rig_index, abs(wavelength - 560) * 100 + rig_index) AS rig_index FROM captures GROUP BY survey)
SELECT survey, min(file) AS file, capture FROM b JOIN r USING (survey, rig_index) GROUP BY survey, capture""",
    ("captures",),
)
def reference_files(spark, sf_dir):
    return scan.reference_files(_band_files(spark, sf_dir))


def _band_files(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "captures").withColumn("file", F.concat(F.lit("F"), F.col("capture").cast("string"), F.lit("_"), F.col("rig_index").cast("string")))


@query(
    """WITH g AS (SELECT survey, capture, list_sort(list(DISTINCT rig_index)) AS s, bool_or(panel) AS panel FROM captures GROUP BY ALL),
f AS (SELECT survey, s AS fullset, row_number() OVER (PARTITION BY survey ORDER BY count(*) DESC, min(capture)) AS rn FROM g GROUP BY survey, s),
l AS (SELECT g.survey, capture FROM g JOIN f ON f.survey = g.survey AND rn = 1 WHERE NOT panel AND len(list_intersect(s, fullset)) = len(fullset)),
r AS (SELECT survey, arg_min(rig_index, abs(wavelength - 560) * 100 + rig_index) AS rig_index FROM captures GROUP BY survey)
SELECT DISTINCT l.survey, l.capture, concat('F', l.capture, '_', c.rig_index) AS file FROM l JOIN r ON r.survey = l.survey JOIN captures c ON c.survey = l.survey AND c.capture = l.capture AND c.rig_index = r.rig_index WHERE l.capture % 3 <> 0""",
    ("captures",),
)
def positioned_captures(spark, sf_dir):
    bands = _band_files(spark, sf_dir)
    places = bands.select("survey", "file", F.lit(37.0).alias("lat"), F.when(F.col("capture") % 3 != 0, 127.0).alias("lon"))
    return scan.positioned_captures(bands, places)


@query(
    """WITH g AS (SELECT survey, capture, list_sort(list(DISTINCT rig_index)) AS s FROM captures GROUP BY ALL),
f AS (SELECT survey, s AS fullset, row_number() OVER (PARTITION BY survey ORDER BY count(*) DESC, min(capture)) AS rn FROM g GROUP BY survey, s),
l AS (SELECT g.survey, capture FROM g JOIN f ON f.survey = g.survey AND rn = 1 WHERE len(list_intersect(s, fullset)) = len(fullset)),
o AS (SELECT c.survey, rig_index, min(wavelength) AS wavelength FROM captures c JOIN l ON l.survey = c.survey AND l.capture = c.capture GROUP BY ALL)
SELECT survey, rig_index, wavelength, row_number() OVER (PARTITION BY survey ORDER BY wavelength, rig_index)::INTEGER AS place FROM o""",
    ("captures",),
)
def output_bands(spark, sf_dir):
    return scan.output_bands(view(spark, sf_dir, "captures"))


@query("WITH c AS (SELECT DISTINCT survey, capture FROM captures), p AS (SELECT *, row_number() OVER (PARTITION BY survey ORDER BY capture) - 1 AS k, greatest(1, count(*) OVER (PARTITION BY survey) // 10) AS step FROM c) SELECT survey, capture FROM p WHERE k % step = 0 AND k // step < 10", ("captures",))
def spread_captures(spark, sf_dir):
    return scan.every_nth(view(spark, sf_dir, "captures").select("survey", "capture").distinct(), "capture")


@query("SELECT view, survey, tx, ty, row_number() OVER (PARTITION BY survey, view ORDER BY ty // 4, tx // 4, ty, tx)::INTEGER AS place FROM frames, range(0, 30) a(tx), range(0, 30) b(ty) WHERE x0 < (tx + 1) * 25 AND x1 > tx * 25 AND y0 < (ty + 1) * 25 AND y1 > ty * 25", ("frames",))
def tile_order(spark, sf_dir):
    tiles = mosaic.tiles_of_views(view(spark, sf_dir, "frames"), 25.0)
    return tiles.withColumn("place", F.row_number().over(Window.partitionBy("survey", "view").orderBy(mosaic.tile_order(F.col("tx"), F.col("ty")))))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'true_color' WHEN 1 THEN 'false_color' ELSE 'gray' END AS kind, CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS red, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS green FROM events""")
def preview_bands(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    names = F.when(F.col("event_id") % 3 == 0, F.array(*map(F.lit, ("Blue", "Green ", "RED", "NIR")))).when(F.col("event_id") % 3 == 1, F.array(*map(F.lit, ("Green", "nir", "Red")))).otherwise(F.array(*map(F.lit, ("Panchro", "LWIR"))))
    p = e.select("event_id", mosaic.preview_bands(names).alias("p"))
    return p.select("event_id", "p.kind", F.col("p.indices")[0].alias("red"), F.col("p.indices")[1].alias("green"))


@query("SELECT survey, row * 100 + col AS label, count(*) AS cells, place FROM (SELECT *, row_number() OVER (PARTITION BY survey ORDER BY n DESC, row * 100 + col) AS place FROM (SELECT survey, row, col, count(*) AS n FROM looks GROUP BY ALL)) JOIN looks USING (survey, row, col) WHERE place <= 10 GROUP BY ALL", ("looks",))
def largest_bodies(spark, sf_dir):
    n = view(spark, sf_dir, "looks").groupBy("survey", (F.col("row") * 100 + F.col("col")).alias("label")).agg(F.count("*").alias("cells"))
    return water.largest_bodies(n).withColumn("place", F.col("place").cast("long"))


@query("SELECT survey, image, v, u, mask FROM masks WHERE (survey, image) IN (SELECT quality::BIGINT, doc_id % 12 FROM labels WHERE toxic = 1)", ("masks",))
def masks_of_images(spark, sf_dir):
    images = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic = 1").select(F.col("quality").cast("long").alias("survey"), (F.col("doc_id") % 12).alias("image"))
    return water.masks_of(view(spark, sf_dir, "masks"), images)


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'on' WHEN 1 THEN 'off' WHEN 4 THEN NULL ELSE 'auto' END AS mode, coalesce(CASE event_id % 5 WHEN 0 THEN event_id % 7 <> 0 WHEN 1 THEN false WHEN 4 THEN NULL ELSE event_id % 7 <> 0 AND event_id % 11 * 0.01 >= 0.05 END, event_id % 7 = 0 AND NULL, false) AS treated FROM events")
def water_modes(spark, sf_dir):
    e = F.col("event_id")
    text = F.when(e % 5 == 0, " On").when(e % 5 == 1, "OFF ").when(e % 5 == 2, "auto").when(e % 5 == 4, "maybe")
    m = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", water.mode_of(text).alias("mode"), F.when(e % 7 != 0, e % 11 * 0.01).alias("f"))
    return m.select("event_id", "mode", F.coalesce(water.decided(F.col("mode"), F.col("f")), F.lit(False)).alias("treated"))


# ---- camera parts ----


@query(f"WITH {_TURNED}, a AS (SELECT image_id, acos(greatest(-1, least(1, (r0 + r4 + r8 - 1) / 2))) AS t, r7 - r5 AS x, r2 - r6 AS y, r3 - r1 AS z FROM m) SELECT image_id, round(t / (2 * sin(t)) * x, 7) + 0.0 AS x, round(t / (2 * sin(t)) * y, 7) + 0.0 AS y, round(t / (2 * sin(t)) * z, 7) + 0.0 AS z FROM a WHERE abs(sin(t)) > 1e-2", ("posed",))
def rotation_vectors(spark, sf_dir):
    t = _turned(spark, sf_dir).withColumn("v", camera.rotation_vector(F.col("r")))
    t = t.filter("abs(sin(acos(greatest(-1, least(1, (r[0] + r[4] + r[8] - 1) / 2))))) > 1e-2")
    return rounded(t.select("image_id", *(F.col("v")[i].alias(c) for i, c in enumerate("xyz"))), 7)


@query(f"WITH {_TURNED} SELECT image_id, round(3e3 * r0 + 19995e-1 * r6, 6) + 0.0 AS p0, round(-3e3 * (r0 * cx + r1 * cy + r2 * cz) - 19995e-1 * (r6 * cx + r7 * cy + r8 * cz), 4) + 0.0 AS p3, round(3e3 * r4 + 14995e-1 * r7, 6) + 0.0 AS p5, round(r8, 9) AS p10, round(-(r6 * cx + r7 * cy + r8 * cz), 6) + 0.0 AS p11 FROM m", ("posed",))
def projection_matrices(spark, sf_dir):
    t = _turned(spark, sf_dir)
    t = t.select("image_id", camera.projection_matrix(camera.matrix(F.col("lens")), F.col("r"), F.col("t")).alias("p"))
    t = t.select("image_id", *(F.col("p")[i].alias(f"p{i}") for i in (0, 3, 5, 10, 11)))
    return t.select("image_id", *((F.round(f"p{i}", d) + F.lit(0.0)).alias(f"p{i}") for i, d in ((0, 6), (3, 4), (5, 6), (10, 9), (11, 6))))


@query(f"WITH {_TURNED} SELECT image_id, round(r0 * 25e0 + r1 * 10 - r2 * 5 - (r0 * cx + r1 * cy + r2 * cz), 6) + 0.0 AS x, round(r6 * 25e0 + r7 * 10 - r8 * 5 - (r6 * cx + r7 * cy + r8 * cz), 6) + 0.0 AS z FROM m", ("posed",))
def camera_coordinates(spark, sf_dir):
    t = _turned(spark, sf_dir)
    p = camera.to_camera(F.col("r"), F.col("t"), F.lit(25.0), F.lit(10.0), F.lit(-5.0))
    return rounded(t.select("image_id", p[0].alias("x"), p[2].alias("z")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 100 >= 0 AND l_quantity * 100 < 4000 AND l_extendedprice / 10 >= 0 AND l_extendedprice / 10 < 3000 AS shown FROM lineitem")
def pixels_in_image(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.select(*_KEYS, camera.in_image(F.col("l_quantity") * 100, F.col("l_extendedprice") / 10, F.lit(4000), F.lit(3000)).alias("shown"))


_RIG = "a AS (SELECT image_id, radians(image_id % 9 - 4) AS a, radians(image_id % 5 - 2) AS b, radians(image_id % 11 - 5) AS c FROM posed)"


@query(f"WITH {_RIG} SELECT image_id, round(cos(b) * cos(c), 9) AS r0, round(-cos(b) * sin(c), 9) + 0.0 AS r1, round(sin(b), 9) + 0.0 AS r2, round(cos(a) * sin(c) + sin(a) * sin(b) * cos(c), 9) + 0.0 AS r3, round(-sin(a) * cos(b), 9) + 0.0 AS r5, round(cos(a) * cos(b), 9) AS r8 FROM a", ("posed",))
def rig_rotations(spark, sf_dir):
    i = F.col("image_id")
    p = view(spark, sf_dir, "posed").select("image_id", camera.rig_rotation(i % 9 - 4, i % 5 - 2, i % 11 - 5).alias("r"))
    return rounded(p.select("image_id", *(F.col("r")[k].alias(f"r{k}") for k in (0, 1, 2, 3, 5, 8))), 9)


@query(f"WITH {_RIG} SELECT image_id, round(cos(c) * cos(b), 9) AS r0, round(sin(c) * cos(a) + cos(c) * sin(b) * sin(a), 9) + 0.0 AS r3_of_transposed, round(cos(a) * cos(b), 9) AS r8 FROM a", ("posed",))
def band_rotations(spark, sf_dir):
    """From the reference camera to a band's, the reference being the rig itself: the rig rotation turned back."""
    i = F.col("image_id")
    rig = camera.rig_rotation(i % 9 - 4, i % 5 - 2, i % 11 - 5)
    one = F.array(*(F.lit(float(k in (0, 4, 8))) for k in range(9)))
    p = view(spark, sf_dir, "posed").select("image_id", camera.band_from_reference(rig, one).alias("r"))
    return rounded(p.select("image_id", F.col("r")[0].alias("r0"), F.col("r")[1].alias("r3_of_transposed"), F.col("r")[8].alias("r8")), 9)


@query(
    """WITH p AS (SELECT event_id, event_id % 6 AS m, 1e3 + event_id % 50 AS a, 5e2 + event_id % 7 AS b, 4e2 + event_id % 3 AS c, 3e2 + event_id % 9 AS d FROM events)
SELECT event_id, a AS fx, CASE WHEN m IN (0, 2, 3) THEN a ELSE b END AS fy, CASE WHEN m IN (0, 2, 3) THEN b ELSE c END - 0.5 AS cx, CASE WHEN m IN (0, 2, 3) THEN c ELSE d END - 0.5 AS cy, CASE WHEN m IN (2, 3) THEN d WHEN m IN (4, 5) THEN 1e-2 ELSE 0 END AS k1, CASE WHEN m = 3 THEN 1e-2 WHEN m IN (4, 5) THEN 2e-2 ELSE 0 END AS k2, CASE WHEN m IN (4, 5) THEN 3e-2 ELSE 0 END AS p1, CASE WHEN m = 5 THEN 5e-2 ELSE 0 END AS k3 FROM p"""
)
def lens_models(spark, sf_dir):
    """K and distortion of each lens model's parameters."""
    e = F.col("event_id")
    model = F.element_at(F.array(*map(F.lit, ("SIMPLE_PINHOLE", "PINHOLE", "SIMPLE_RADIAL", "RADIAL", "OPENCV", "FULL_OPENCV"))), (e % 6 + 1).cast("int"))
    params = F.array(1000.0 + e % 50, 500.0 + e % 7, 400.0 + e % 3, 300.0 + e % 9, *(F.lit(v) for v in (0.01, 0.02, 0.03, 0.04, 0.05)))
    c = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", camera.intrinsics(model, params).alias("c"))
    c = c.select("event_id", camera.matrix(F.col("c")).alias("k"), camera.distortion(F.col("c")).alias("d"))
    return c.select("event_id", *(F.col("k")[i].alias(n) for n, i in (("fx", 0), ("fy", 4), ("cx", 2), ("cy", 5))), *(F.col("d")[i].alias(n) for n, i in (("k1", 0), ("k2", 1), ("p1", 2), ("k3", 4))))


@query("SELECT event_id, concat(1000 + event_id % 50, ',1500.25,640,480.5,-0.1,0.0', event_id % 9 + 1, ',0,0,0,0,0,0') AS params FROM events")
def lens_texts(spark, sf_dir):
    e = F.col("event_id")
    lens = camera.intrinsics(F.lit("FULL_OPENCV"), F.array(1000.0 + e % 50, *(F.lit(v) for v in (1500.25, 640.0, 480.5, -0.1)), (e % 9 + 1) * 0.01, *(F.lit(0.0),) * 3))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", camera.lens_text(lens).alias("params"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(floor((l_extendedprice - 7) / 25e-1 + 1e-9) * 25e-1 + 7, 6) AS low, round(ceil((l_extendedprice - 7) / 25e-1 - 1e-9) * 25e-1 + 7, 6) AS high FROM lineitem")
def snapped_bounds(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    side = lambda up: options.snap(F.col("l_extendedprice"), F.lit(2.5), F.lit(7.0), up)
    return rounded(t.select(*_KEYS, side(False).alias("low"), side(True).alias("high")))


@query("SELECT file, file || '.jpg' AS proxy, file AS back FROM shots", ("shots",))
def proxy_names(spark, sf_dir):
    p = view(spark, sf_dir, "shots").select("file", scalars.proxy_name(F.col("file")).alias("proxy"))
    return p.select("file", "proxy", scalars.file_of_proxy(F.col("proxy")).alias("back"))


@query("SELECT event_id, 'keep' AS names FROM events")
def dropped_outputs(spark, sf_dir):
    m = F.create_map(F.lit("indices"), F.lit("a"), F.lit("keep"), F.lit("b"), F.lit("index_preview"), F.lit("c"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.array_join(F.map_keys(scalars.drop_keys(m, ["indices", "index_previews", "index_preview"])), ",").alias("names"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'NDVI,EVI' WHEN 1 THEN 'NDRE' WHEN 2 THEN '' ELSE 'NDVI,GNDVI,CIg' END AS chosen FROM events")
def chosen_indices(spark, sf_dir):
    e = F.col("event_id")
    asked = F.when(e % 4 == 0, F.array(F.lit("evi "), F.lit("NDVI"), F.lit("ndvi"))).when(e % 4 == 1, F.array(F.lit("Ndre"))).when(e % 4 == 2, F.array(F.lit("none"))).otherwise(F.array(*map(F.lit, ("cig", "gndvi", "ndvi"))))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.array_join(scalars.in_registry_order(list(indices.REGISTRY), asked), ",").alias("chosen"))


@query(
    """WITH p AS (SELECT point_id AS gcp, image_id, u, v FROM measured WHERE u >= 0 AND u < 4000 AND v >= 0 AND v < 3000), d AS (SELECT gcp, image_id, min(u) AS u, min(v) AS v FROM p GROUP BY ALL),
c AS (SELECT gcp, image_id, image_id % 5 = 0 AS marked, sqrt(pow((u - 2000) / 4000, 2) + pow((v - 1500) / 3000, 2)) AS center_dist FROM d)
SELECT gcp, image_id, marked, round(center_dist, 7) AS center_dist, row_number() OVER (PARTITION BY gcp ORDER BY marked DESC, round(center_dist, 9), image_id)::INTEGER AS place FROM c""",
    ("measured",),
)
def marking_candidates(spark, sf_dir):
    p = view(spark, sf_dir, "measured").filter(camera.in_image(F.col("u"), F.col("v"), F.lit(4000), F.lit(3000))).groupBy(F.col("point_id").alias("gcp"), "image_id").agg(F.min("u").alias("u"), F.min("v").alias("v"))
    out = observations.candidates(p.withColumns({"width": F.lit(4000), "height": F.lit(3000)}), p.filter("image_id % 5 = 0"))
    return rounded(out.select("gcp", "image_id", "marked", "center_dist", "place"), 7)


@query("SELECT CASE WHEN count(DISTINCT e) = 1 AND min(e) <> 4326 THEN min(e) ELSE 32652 END AS epsg FROM (SELECT 5186 AS e FROM part WHERE p_partkey % 3 <> 0)")
def target_system(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.when(F.col("p_partkey") % 3 == 0, "check").otherwise("control").alias("role"), F.when(F.col("p_partkey") % 3 == 0, 4326).otherwise(5186).alias("epsg"))
    return observations.target_system(p, 32652, [4326])


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
