"""Map rasters (north-up GeoTIFFs) as tables: a row a cell with its bands, and a row a file with its georeference.

Files are read in tasks, a strip of rows a batch. Reading smaller is a mean over cells, reading a part a filter on places.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError, ProjectError
from ..functions.indices import REGISTRY
from .headers import tiff_pixels, tiff_tags

#: Cells of a batch at most.
BATCH = 1 << 18
# Tags of a raster's cell size, tie point, keys, names and empty value; keys that hold the system; orders of channels.
SCALE, TIE, KEYS, NOTES, EMPTY, SYSTEMS = 33550, 33922, 34735, 42112, 42113, (3072, 2048)
ORDERS = {"RGBA": (0, 1, 2, 3), "RGB": (0, 1, 2), "BGRA": (2, 1, 0, 3), "BGR": (2, 1, 0)}
GEOREF = "file string, west double, north double, res double, rows int, cols int, epsg int, empty double, names array<string>"


def georeference(data: bytes) -> dict:
    """west, north (of the upper left corner), res, rows, cols, epsg, empty value and band names of a GeoTIFF; None where unknown."""
    t, _ = tiff_tags(data)
    scale, tie, keys = t.get(SCALE), t.get(TIE), t.get(KEYS) or ()
    told = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4)}
    bands = int(t.get(277, 1))
    notes = dict((int(i), n.strip()) for i, n in re.findall(r'<Item name="DESCRIPTION" sample="(\d+)"[^>]*>([^<]*)</Item>', str(t.get(NOTES, ""))))
    res = float(scale[0]) if scale else None
    west, north = (tie[3] - tie[0] * res, tie[4] + tie[1] * res) if tie and res else (None, None)
    empty = t.get(EMPTY)
    empty = float(empty) if isinstance(empty, str) and re.fullmatch(r"\s*(nan|[-+]?[\d.]+(e[-+]?\d+)?)\s*", empty, re.I) else None
    return {"west": west, "north": north, "res": res, "rows": int(t[257]), "cols": int(t[256]), "epsg": next((int(told[k]) for k in SYSTEMS if k in told), None), "empty": empty, "names": [notes.get(i) or f"band{i + 1}" for i in range(bands)]}


def _files(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif*").load(path).filter("lower(path) rlike '[.]tiff?$' and not path like '%.tmp.tif'")
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "content")


def georeferences(spark: SparkSession, path: str) -> DataFrame:
    """GEOREF of each raster."""

    def read(batches):
        kinds = [pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.string())]
        names = [x.split()[0] for x in GEOREF.split(", ")]
        for b in batches:
            rows = [{"file": f, **georeference(d.as_py())} for f, d in zip(b.column("file").to_pylist(), b.column("content"))]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)

    return _files(spark, path).mapInArrow(read, GEOREF)


def read_cells(spark: SparkSession, path: str, shrink: int = 1, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(file, row, col, x, y, values) of each raster's cells: centres in map coordinates, and the bands' values, NaN where empty.

    shrink: cells of so many by so many become their mean. bounds: only cells whose centre lies inside (xmin, ymin, xmax, ymax).
    """
    if shrink < 1:
        raise InputError("shrink is a whole number from 1", "invalid_argument")
    schema = "file string, row int, col int, x double, y double, values array<double>"

    def read(batches):
        for b in batches:
            for name, raw in zip(b.column("file").to_pylist(), b.column("content")):
                data = raw.as_py()
                g, p = georeference(data), tiff_pixels(data)
                p = p if p.ndim == 3 else p[:, :, None]
                res, west, north = g["res"] or 1.0, g["west"] or 0.0, g["north"] or 0.0
                step = max(1, BATCH // max(p.shape[1], 1))
                for at in range(0, p.shape[0], step):
                    part = p[at : at + step].astype(float)
                    if g["empty"] is not None:
                        part[part == g["empty"]] = np.nan
                    r, c = (k.ravel() for k in np.indices(part.shape[:2]))
                    n = len(r)
                    flat = pa.ListArray.from_arrays(np.arange(0, (n + 1) * part.shape[2], part.shape[2], dtype=np.int32), pa.array(part.ravel()))
                    x, y = west + (c + 0.5) * res, north - (r + at + 0.5) * res
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array((r + at).astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(x), pa.array(y), flat], [f.split()[0] for f in schema.split(", ")])

    cells = _files(spark, path).mapInArrow(read, schema)
    if bounds is not None:
        cells = cells.filter(F.col("x").between(bounds[0], bounds[2]) & F.col("y").between(bounds[1], bounds[3]))
    if shrink == 1:
        return cells
    # a band's mean over the block's cells that have it
    part = cells.select("file", F.expr(f"cast(row div {shrink} as int)").alias("row"), F.expr(f"cast(col div {shrink} as int)").alias("col"), "x", "y", F.posexplode("values").alias("band", "v"))
    each = part.groupBy("file", "row", "col", "band").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg(F.when(~F.isnan("v"), F.col("v"))).alias("v"))
    whole = each.groupBy("file", "row", "col").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.array_sort(F.collect_list(F.struct("band", "v"))).alias("b"))
    return whole.select("file", "row", "col", "x", "y", F.transform("b", lambda b: F.coalesce(b["v"], F.lit(float("nan")))).alias("values"))


def reordered(values: Column, order: str) -> Column:
    """The channels of red, green, blue, alpha in another order."""
    if order.upper() not in ORDERS:
        raise InputError(f"an order is one of {', '.join(ORDERS)}", "invalid_argument")
    return F.array(*(values[i] for i in ORDERS[order.upper()]))


def read_surface(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A surface's cells (survey: the file, row, col, z) and grids (survey, x0, y0 at the first cell's centre, res, rows, cols)."""
    grids = georeferences(spark, path).select(F.col("file").alias("survey"), (F.col("west") + F.col("res") / 2).alias("x0"), (F.col("north") - F.col("res") / 2).alias("y0"), "res", "rows", "cols")
    cells = read_cells(spark, path).select(F.col("file").alias("survey"), "row", "col", F.col("values")[0].alias("z"))
    return cells.filter(~F.isnan("z")), grids


def index_order(names: list[str]) -> list[str]:
    """Known indices in the registry's order, then the others by name."""
    have = {n.upper(): n for n in names}
    known = [k for k in REGISTRY if k.upper() in have]
    return known + sorted(n for u, n in have.items() if u not in {k.upper() for k in known})


def read_indices(spark: SparkSession, path: str, index: str | None = None) -> DataFrame:
    """(index, row, col, x, y, value) of a folder with a raster an index; of one of them (any case) if asked."""
    files = [r.file for r in _files(spark, path).select("file").distinct().collect()]  # a few names
    names = index_order([f.rsplit(".", 1)[0] for f in files])
    if not names:
        raise ProjectError("there are no index rasters", "not_rendered")
    if index is not None and index.upper() not in {n.upper() for n in names}:
        raise InputError(f"no index {index}; there are {', '.join(names)}", "invalid_argument")
    cells = read_cells(spark, path).withColumn("index", F.upper(F.regexp_replace("file", r"\.[^.]*$", "")))
    cells = cells.filter(F.col("index") == index.upper()) if index is not None else cells
    return cells.select("index", "row", "col", "x", "y", F.col("values")[0].alias("value"))
