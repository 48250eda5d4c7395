"""Views of the driver's tables as a survey's tables, in SQL that Spark and DuckDB both read.

Each derivation is plain arithmetic on keys and measures, with nulls put in by modulus, so that an operator's query and its SQL
start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "shots": """
SELECT user_id AS survey, event_id,
  concat('DJI_', lpad(CAST(event_id AS STRING), 7, '0'), CASE WHEN event_id % 5 = 0 THEN '_W' WHEN event_id % 5 = 1 THEN '_T' ELSE '' END, '.JPG') AS file,
  'DJI' AS make, event_type AS model, concat(event_type, '-', CAST(event_id % 3 AS STRING)) AS camera_key,
  CASE WHEN event_id % 11 <> 0 THEN lpad(CAST(event_id * 7919 % 100003 AS STRING), 8, '0') END AS datetime,
  CASE WHEN event_id % 3 = 0 THEN 24e0 WHEN event_id % 7 <> 0 THEN 28e0 + event_id % 4 END AS focal_35mm, 8e0 + event_id % 3 AS focal_mm,
  CASE WHEN event_id % 17 <> 0 THEN 127e0 + (event_id % 89) * 2e-4 END AS lon, CASE WHEN event_id % 17 <> 0 THEN 37e0 + (event_id % 97) * 15e-5 END AS lat,
  CASE WHEN event_id % 13 <> 0 THEN 100e0 + value / 10e0 END AS abs_alt, CASE WHEN user_id % 2 = 0 OR event_id % 19 <> 0 THEN 2e0 + value / 20e0 END AS rel_alt,
  CASE WHEN event_id % 6 <> 0 THEN (event_id * 37 % 360) - 18e1 END AS gimbal_yaw,
  CASE WHEN event_id % 4 <> 0 THEN (event_id * 37 % 360) - 18e1 - CASE WHEN user_id % 3 = 0 THEN 9e0 + (event_id % 5) * 5e-1 ELSE event_id % 50 END END AS flight_yaw,
  CASE WHEN event_id % 9 <> 0 THEN -9e1 + (event_id % 31) END AS gimbal_pitch,
  CASE WHEN event_id % 4 = 0 THEN 50 WHEN event_id % 4 = 1 THEN 16 END AS rtk_flag,
  CASE WHEN event_id % 2 = 0 THEN 4000 ELSE 5472 END AS width, CASE WHEN event_id % 2 = 0 THEN 3000 ELSE 3648 END AS height,
  event_id % 23 <> 0 AS selected, (event_id % 89) * 18e0 AS e, (event_id % 97) * 17e0 AS n
FROM events""",
    "errors": """
SELECT l_partkey AS point_id, l_suppkey AS image_id, l_linenumber AS p2d_idx, l_orderkey, l_discount * 2e1 + l_tax * 1e1 + (l_orderkey % 7) * 5e-2 AS err FROM lineitem""",
    "cloud": """
SELECT p_partkey AS point_id, (p_partkey * 37 % 1000) * 5e-1 AS x, (p_partkey * 91 % 997) * 4e-1 AS y, p_retailprice / 5e1 + (p_size % 5) AS z, (p_partkey % 9) * 4e-1 AS error, p_partkey % 6 + 1 AS track, p_partkey % 4 AS survey FROM part""",
    "posed": """
SELECT s_suppkey AS image_id, concat('IMG_', lpad(CAST(s_suppkey AS STRING), 4, '0'), CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '.jpg' END) AS name, s_nationkey AS camera_id, s_suppkey % 8 <> 5 AS has_pose,
  (s_suppkey * 29 % 100) * 5e0 AS cx, (s_suppkey * 53 % 101) * 4e0 AS cy, 9e1 + s_suppkey % 10 AS cz, s_suppkey % 4 AS survey FROM supplier""",
    "measured": """
SELECT l_partkey AS point_id, l_suppkey AS image_id, l_linenumber AS p2d_idx, l_orderkey,
  2e3 + 3e3 * ((p_partkey * 37 % 1000) * 5e-1 - (s_suppkey * 29 % 100) * 5e0) / (9e1 + s_suppkey % 10 - (p_retailprice / 5e1 + (p_size % 5))) + l_discount * 10 AS u,
  15e2 - 3e3 * ((p_partkey * 91 % 997) * 4e-1 - (s_suppkey * 53 % 101) * 4e0) / (9e1 + s_suppkey % 10 - (p_retailprice / 5e1 + (p_size % 5))) - l_tax * 10 AS v
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey""",
    "pixels": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 1e-2 AS nir, CASE WHEN l_orderkey % 29 <> 0 THEN l_discount END AS red, l_tax AS green, l_discount * 5e-1 AS blue, l_tax + l_discount AS edge FROM lineitem""",
    "captures": """
SELECT DISTINCT l_suppkey % 5 AS survey, l_orderkey AS capture, l_linenumber AS rig_index, CASE l_linenumber WHEN 1 THEN 'Blue' WHEN 2 THEN 'Green' WHEN 3 THEN 'Red' ELSE 'NIR' END AS band, 4e2 + 8e1 * l_linenumber AS wavelength, l_orderkey % 31 = 0 AS panel FROM lineitem""",
    "series": """
SELECT CAST(l_suppkey % 5 AS BIGINT) AS survey, l_linenumber AS band, l_orderkey AS capture, concat(CAST(l_orderkey AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS file,
  CASE WHEN l_orderkey % 7 <> 0 THEN lpad(CAST(l_orderkey AS STRING), 9, '0') END AS datetime, CASE WHEN l_partkey % 10 <> 0 THEN l_extendedprice / 1e3 END AS irradiance FROM lineitem""",
    "panels": """
SELECT CAST(l_suppkey % 5 AS BIGINT) AS survey, l_suppkey AS capture, l_linenumber AS band, l_quantity * 12e2 AS raw, 65535e0 AS full_scale, l_extendedprice * 1e-5 AS radiance FROM lineitem""",
    "levels": """
SELECT l_partkey AS point, l_suppkey AS capture, avg(l_discount * 1e1 + (l_suppkey % 7) * 3e-2) AS v FROM lineitem GROUP BY l_partkey, l_suppkey""",
    "looks": """
SELECT l_suppkey % 20 AS survey, CAST(l_partkey % 20 AS INT) AS row, CAST(l_orderkey % 15 AS INT) AS col, concat(CAST(l_orderkey AS STRING), ':', CAST(l_linenumber AS STRING), ':', CAST(l_partkey AS STRING)) AS view,
  CAST(l_quantity AS INT) % 3 AS mask, l_extendedprice / 1e2 AS r, l_discount * 255e1 AS red, l_tax * 255e1 AS green FROM lineitem""",
    "frames": """
SELECT o_orderkey AS view, o_custkey % 10 AS survey, (o_orderkey * 13 % 500) * 1e0 AS x0, (o_orderkey * 7 % 400) * 1e0 AS y0, (o_orderkey * 13 % 500) + 2e1 + o_custkey % 60 AS x1, (o_orderkey * 7 % 400) + 15e0 + o_custkey % 45 AS y1 FROM orders""",
    "marks": """
SELECT l_partkey AS gcp, l_orderkey * 10 + l_linenumber AS ordinal, concat('IMG_', lpad(CAST(l_suppkey AS STRING), 4, '0')) AS image, l_quantity AS x, l_tax AS y, l_partkey * 1000 + l_suppkey AS tie FROM lineitem""",
    "masks": """
SELECT CAST(quality AS BIGINT) AS survey, doc_id % 12 AS image, CAST(doc_id AS BIGINT) AS v, 0 AS u, CASE WHEN quality = 1 THEN CAST(doc_id % 3 AS INT) ELSE CAST(doc_id % 3 AS INT) * 100 END AS mask FROM labels""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view's DataFrame over the tables in a folder."""
    sql = VIEWS[name]
    used = [t for t in TABLES if f" {t}" in sql]
    for t in used:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def with_views(*names: str) -> str:
    """WITH clause of views for an oracle's SQL."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
