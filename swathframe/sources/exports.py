"""Exports: camera tables, point clouds, rasters, mask outlines."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.camera import opk_from_rotation
from ..functions.geodesy import inverse
from .headers import tiff_bytes


def camera_csv_line(name: Column, x: Column, y: Column, z: Column, r: Column) -> Column:
    """name,x,y,z,omega,phi,kappa with fixed decimals."""
    o = opk_from_rotation(r)
    return F.format_string("%s,%.4f,%.4f,%.4f,%.6f,%.6f,%.6f", name, x, y, z, o["omega"] + 0.0, o["phi"] + 0.0, o["kappa"] + 0.0)


def corners_lonlat(west: Column, north: Column, cell: Column, rows: Column, cols: Column, epsg: int) -> Column:
    """Array of lon, lat structs of a raster's corners: upper left, upper right, lower right, lower left."""
    east, south = west + cell * cols, north - cell * rows

    def at(x, y):
        lon, lat = inverse(x, y, epsg)
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    return F.array(at(west, north), at(east, north), at(east, south), at(west, south))


def ply_bytes(points: DataFrame) -> bytes:
    """Binary little-endian PLY of points (x, y, z, red, green, blue) in the order of point_id; one cloud, for a viewer."""
    t = points.orderBy("point_id").select("x", "y", "z", "red", "green", "blue").toArrow()
    body = np.zeros(t.num_rows, np.dtype([("xyz", "<f8", 3), ("rgb", "u1", 3)]))
    body["xyz"] = np.stack([t.column(c).to_numpy() for c in "xyz"], axis=1) if t.num_rows else np.zeros((0, 3))
    body["rgb"] = np.stack([t.column(c).to_numpy() for c in ("red", "green", "blue")], axis=1) if t.num_rows else np.zeros((0, 3))
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {t.num_rows}\n" + "".join(f"property double {c}\n" for c in "xyz") + "".join(f"property uchar {c}\n" for c in ("red", "green", "blue")) + "end_header\n"
    return head.encode() + body.tobytes()


def ply_points(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and colours of such a PLY."""
    head, _, body = data.partition(b"end_header\n")
    n = int(head.split(b"element vertex ")[1].split()[0])
    rows = np.frombuffer(body, np.dtype([("xyz", "<f8", 3), ("rgb", "u1", 3)]), n)
    return rows["xyz"], rows["rgb"]


def grid_tiff(cells: DataFrame, value: str, rows: int, cols: int, west: float, north: float, cell: float, epsg: int) -> bytes:
    """GeoTIFF of one survey's grid; cells without a value are NaN."""
    t = cells.select("row", "col", F.col(value).cast("float").alias("v")).toArrow()
    out = np.full((rows, cols), np.nan, np.float32)
    out[t.column("row").to_numpy(), t.column("col").to_numpy()] = t.column("v").to_numpy()
    return tiff_bytes(out, west, north, cell, epsg)


def outlines(mask: np.ndarray, west: float, north: float, cell: float) -> list[list[tuple[float, float]]]:
    """Closed outer boundaries of a mask's components (along cell edges, without repeated corners on a line), in map coordinates."""
    from ..operators.grids import filled, labels_of

    out, label = [], labels_of(mask, corners=False)
    for k in range(1, label.max() + 1):
        m = np.pad(filled(label == k), 1)
        edges = {}
        for i, j in zip(*np.nonzero(m)):  # each cell's free sides, clockwise
            for free, a, b in ((m[i - 1, j], (i, j), (i, j + 1)), (m[i, j + 1], (i, j + 1), (i + 1, j + 1)), (m[i + 1, j], (i + 1, j + 1), (i + 1, j)), (m[i, j - 1], (i + 1, j), (i, j))):
                if not free:
                    edges.setdefault(a, []).append(b)
        start = min(edges)
        ring, at, way = [], start, None
        while True:
            choice = edges[at]
            # at a corner where two cells touch, turn right and stay with the same cell
            turn = {(0, 1): 0, (1, 0): 1, (0, -1): 2, (-1, 0): 3}
            step = lambda b, at=at: (b[0] - at[0], b[1] - at[1])
            b = choice[0] if len(choice) == 1 or way is None else min(choice, key=lambda q: (turn[step(q)] - turn[way] + 1) % 4 != 2)
            choice.remove(b)
            if way is None or step(b) != way:
                ring.append(at)
            way, at = step(b), b
            if at == start:
                break
        out.append([(west + (j - 1) * cell, north - (i - 1) * cell) for i, j in [*ring, ring[0]]])
    return out


def png_bytes(pixels: np.ndarray) -> bytes:
    """PNG of bytes (rows, columns, 1, 3 or 4 channels)."""
    import zlib

    p = np.ascontiguousarray(pixels if pixels.ndim == 3 else pixels[:, :, None]).astype(np.uint8)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = np.concatenate([np.zeros((len(p), 1), np.uint8), p.reshape(len(p), -1)], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", p.shape[1], p.shape[0], 8, {1: 0, 3: 2, 4: 6}[p.shape[2]], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
