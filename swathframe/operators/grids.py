"""Masks of one survey's grid: components, holes, discs, the area of a survey."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labels_of(mask: np.ndarray, corners: bool = True) -> np.ndarray:
    """Components of a mask under eight neighbours (or four): 0 outside, else 1, 2, ... in the order of their first cells."""
    rows, cols = mask.shape
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1).ravel()
    # runs of cells in a row; a row's places are one more than its cells, and a run ends before `end`
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # of each run, those of the next row that it touches: they follow one another
    reach = int(corners)
    low, high = np.searchsorted(end, begin + cols + 1 - reach, side="right"), np.searchsorted(begin, end + cols + 1 + reach, side="left")
    if reach:  # not beyond the next row's ends
        low, high = np.maximum(low, np.searchsorted(begin, (begin // (cols + 1) + 1) * (cols + 1))), np.minimum(high, np.searchsorted(begin, (begin // (cols + 1) + 2) * (cols + 1)))
    many = np.maximum(high - low, 0)
    x = np.repeat(np.arange(len(begin)), many)
    y = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    top = np.arange(len(begin))
    while len(x):
        least = np.minimum(top[x], top[y])
        new = top.copy()
        for part in (x, y, top[x], top[y]):
            np.minimum.at(new, part, least)
        new = new[new]  # a run's label jumps to its label's label
        if (new == top).all():
            break
        top = new
    names, code = np.unique(top, return_inverse=True)
    out = np.zeros(mask.shape, np.int64)
    out[mask] = np.repeat(code + 1, end - begin)
    return out


def dilated(mask: np.ndarray, radius: float) -> np.ndarray:
    """Cells within a distance of the mask, by sums along rows for each row offset."""
    r = int(np.floor(radius))
    rows, cols = mask.shape
    out = np.zeros_like(mask)
    sums, wide = np.zeros((rows, cols + 2 * r + 1), np.int32), {}
    np.cumsum(mask, axis=1, out=sums[:, r + 1 : r + 1 + cols])
    sums[:, r + 1 + cols :] = sums[:, r + cols : r + cols + 1]
    for d in range(-min(r, rows), min(r, rows) + 1):
        w = int(np.floor(np.sqrt(radius * radius - d * d)))
        if w not in wide:
            wide[w] = sums[:, r + w + 1 : r + w + 1 + cols] > sums[:, r - w : r - w + cols]
        a, b = max(0, d), min(rows, rows + d)
        out[a:b] |= wide[w][a - d : b - d]
    return out


def eroded(mask: np.ndarray, radius: float) -> np.ndarray:
    """Cells farther than a distance from every cell outside the mask; what lies beyond the grid doesn't count."""
    return ~dilated(~mask, radius)


def filled(mask: np.ndarray) -> np.ndarray:
    """The mask and what it encloses."""
    label = labels_of(~np.pad(mask, 1), corners=False)
    return (label != label[0, 0])[1:-1, 1:-1] | mask


def survey_area(covered: np.ndarray, bridge: float) -> np.ndarray:
    """The covered cells, their holes, and gaps no wider than a closing spans that part two or more covered pieces."""
    area, pieces = filled(covered), labels_of(covered)
    if pieces.max() <= 1:
        return area
    closed = eroded(dilated(np.pad(covered, int(bridge) + 1), bridge), bridge)[int(bridge) + 1 : -int(bridge) - 1, int(bridge) + 1 : -int(bridge) - 1] | covered
    added, around = labels_of(closed & ~area), np.pad(np.where(covered, pieces, 0), 1)
    r, c = np.nonzero(added)
    near = np.concatenate([np.stack([added[r, c], around[r + i, c + j]]) for i in range(3) for j in range(3)], axis=1)
    pairs = np.unique(near[:, near[1] > 0], axis=1)  # added regions and the pieces that they touch
    return filled(area | (np.bincount(pairs[0], minlength=int(added.max()) + 1) >= 2)[added])


def _counts(t: pa.Table) -> tuple[np.ndarray, int, int]:
    """Counts of a survey's cells as a grid, and the row and column of its first; from cells, or from spans of them up to `after`."""
    r, c, n = (t.column(k).to_numpy() for k in ("row", "col", "n"))
    after = t.column("after").to_numpy() if "after" in t.column_names else c + 1
    r0, c0 = r.min(), c.min()
    rows, cols = int(r.max() - r0) + 1, int(after.max() - c0)
    counts, many = np.zeros(rows * cols, np.int64), after - c
    counts[np.repeat((r - r0) * cols + c - c0 - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))] = np.repeat(n, many)
    return counts.reshape(rows, cols), r0, c0


def _area(counts: np.ndarray, cell: float, bridge_m: float, border_m: float) -> tuple[np.ndarray, np.ndarray]:
    area = survey_area(counts > 0, bridge_m / cell)
    return area, eroded(area, border_m / cell)


def area_cells(grid: DataFrame, bridge_m: float, border_m: float) -> DataFrame:
    """(survey, row, col, n, gap, interior, cell) of the cells of each survey's area, from counts (survey, row, col, n, cell).

    A gap has no footprint; the interior is farther than border_m from the area's edge. A group is one survey's cells, which a flight bounds.
    """

    def one(t: pa.Table) -> pa.Table:
        cell = t.column("cell")[0].as_py()
        counts, r0, c0 = _counts(t)
        area, inside = _area(counts, cell, bridge_m, border_m)
        i, j = np.nonzero(area)
        return pa.table({"survey": pa.array([t.column("survey")[0].as_py()] * len(i), t.schema.field("survey").type), "row": (i + r0).astype(np.int32), "col": (j + c0).astype(np.int32), "n": counts[i, j], "gap": counts[i, j] == 0, "interior": inside[i, j], "cell": np.full(len(i), float(cell))})

    kind = grid.schema["survey"].dataType.simpleString()
    return _places(grid).groupBy("survey").applyInArrow(one, f"survey {kind}, row int, col int, n long, gap boolean, interior boolean, cell double")


def area_counts(spans: DataFrame, bridge_m: float, border_m: float) -> DataFrame:
    """(survey, n, gap, interior, cell, cells): what area_cells gives, counted: how many cells are alike. From counts of spans
    (survey, row, col, after, n, cell), so that cells are no rows on either side of a survey's group."""

    def one(t: pa.Table) -> pa.Table:
        cell = t.column("cell")[0].as_py()
        counts, _, _ = _counts(t)
        area, inside = _area(counts, cell, bridge_m, border_m)
        alike, cells = np.unique(counts[area] << 1 | inside[area], return_counts=True)
        return pa.table({"survey": pa.array([t.column("survey")[0].as_py()] * len(alike), t.schema.field("survey").type), "n": alike >> 1, "gap": alike < 2, "interior": (alike & 1) == 1, "cell": np.full(len(alike), float(cell)), "cells": cells.astype(np.int64)})

    kind = spans.schema["survey"].dataType.simpleString()
    return _places(spans, "after").groupBy("survey").applyInArrow(one, f"survey {kind}, n long, gap boolean, interior boolean, cell double, cells long")


def _places(grid: DataFrame, *more: str) -> DataFrame:
    return grid.select("survey", *(F.col(c).cast("int").alias(c) for c in ("row", "col", *more)), F.col("n").cast("long").alias("n"), F.col("cell").cast("double").alias("cell"))
