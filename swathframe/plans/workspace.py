"""A survey's workspace: tables and documents in a folder of any store, and the operations on them.

Tables are Parquet under tables/, documents JSON under docs/, both through Spark and Hadoop's file system. A table is written beside
its old version and takes its place by renaming, so that a failed operation leaves the old one.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError, ProjectError
from ..functions import geodesy, indices
from ..functions.scalars import version_parts
from ..operators import coverage, mosaic, observations, rays, scan, sfm, surface, water, waterimage
from ..streaming.events import Reporter
from .options import GridOptions, PreviewOptions, gridded, refuse

EDITS_VERSION, REPORT_VERSION = 1, 1
EDITS = {"version": EDITS_VERSION, "deleted_points": [], "max_reproj_error_px": None, "tiepoints": [], "gcps": []}
UNSET = object()


class Store:
    """Files of a folder through Hadoop's file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}"))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def swap(self, new: str, name: str) -> None:
        """new takes the place of name; the old one comes back if that fails."""
        old = f"{name}.{uuid.uuid4().hex}.old"
        had = self.exists(name)
        if had and not self._fs.rename(self._path(f"{self.root}/{name}"), self._path(f"{self.root}/{old}")):
            raise OSError(f"can't replace {name}")
        self._fs.mkdirs(self._path(f"{self.root}/{name}").getParent())
        if not self._fs.rename(self._path(f"{self.root}/{new}"), self._path(f"{self.root}/{name}")):
            if had:
                self._fs.rename(self._path(f"{self.root}/{old}"), self._path(f"{self.root}/{name}"))
            raise OSError(f"can't place {name}")
        if had:
            self.delete(old)

    def write(self, name: str, df: DataFrame) -> DataFrame:
        new = f"staged/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{new}")
        self.swap(new, f"tables/{name}")
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/tables/{name}")

    def put(self, name: str, document: dict) -> None:
        new = f"staged/{uuid.uuid4().hex}"
        self.spark.createDataFrame([(json.dumps(document, ensure_ascii=False),)], "value string").coalesce(1).write.text(f"{self.root}/{new}")
        self.swap(new, f"docs/{name}")

    def get(self, name: str) -> dict | None:
        if not self.exists(f"docs/{name}"):
            return None
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.root}/docs/{name}").collect()))


class Project:
    """create() with shots, align() with a reconstruction's tables, then mosaics, indices, edits and refinements."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.store = spark, Store(spark, folder)

    @classmethod
    def create(cls, shots: DataFrame, folder: str) -> Project:
        p = cls(shots.sparkSession, folder)
        p.store.write("shots", shots)
        p.store.put("meta", {"engine": "1", "render": None})
        return p

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Project:
        p = cls(spark, folder)
        if not p.store.exists("tables/base_points"):
            raise ProjectError("the workspace has no reconstruction", "not_aligned")
        return p

    # ---- previews ----

    def preview(self, options: PreviewOptions | None = None, epsg: int | None = None, report: Reporter | None = None) -> dict:
        """Poses, footprints and coverage of the shots: tables, and statistics by survey."""
        options, report = options or PreviewOptions(), report or Reporter()
        report.stage("preview", "poses")
        shots = scan.with_selection(scan.with_flags(self.store.table("shots"))).filter("selected and lat is not null and lon is not null")
        middle = shots.agg(F.median("lon").alias("lon"), F.median("lat").alias("lat")).first()
        if middle.lon is None:
            raise InputError("no shot has a position", "no_gps")
        epsg = epsg or self.spark.range(1).select(geodesy.utm_epsg(F.lit(middle.lon), F.lit(middle.lat)).alias("e")).first().e
        x, y = geodesy.forward(F.col("lon"), F.col("lat"), epsg)
        poses = self.store.write("poses", coverage.build_poses(shots.withColumns({"e": x, "n": y})))
        report.stage("coverage", "footprints")
        prints = coverage.footprints(poses)
        bounds = coverage.survey_bounds(prints, options.max_size)
        grid = self.store.write("coverage", coverage.coverage_grid(prints, bounds).join(bounds.select("survey", "cell"), "survey"))
        stats = coverage.coverage_stats(grid.withColumn("interior", F.lit(True))).collect()
        result = {"epsg": epsg, "surveys": [r.asDict() for r in stats], "warnings": [w for r in coverage.warnings(poses).collect() for w in r.warnings]}
        self.store.put("preview", result)
        return result

    # ---- reconstructions ----

    def align(self, points: DataFrame, images: DataFrame, cameras: DataFrame, obs: DataFrame, epsg: int, report: Reporter | None = None) -> dict:
        """Takes a reconstruction in map coordinates as the base. Products and refinements of an older one go; marks stay."""
        (report or Reporter()).stage("align", "tables")
        if geodesy.is_geographic(epsg):
            raise InputError("the reconstruction's system is projected", "invalid_argument")
        for name, df in (("points", points), ("images", images), ("cameras", cameras), ("observations", obs)):
            self.store.write(f"base_{name}", df)
            self.store.delete(f"tables/refined_{name}")
        for stale in ("tables/mosaic", "tables/indices", "docs/render"):
            self.store.delete(stale)
        edits = self.edits()
        self.store.put("edits", {**edits, "deleted_points": []})
        stats = observations.reproj_stats(self.errors("base")).first().asDict()
        out = {"report_version": REPORT_VERSION, "epsg": epsg, "reprojection": stats, "registered": images.filter("has_pose").count()}
        self.store.put("align", out)
        return out

    def current(self) -> str:
        return "refined" if self.store.exists("tables/refined_points") else "base"

    def reconstruction(self, which: str | None = None) -> dict[str, DataFrame]:
        which = which or self.current()
        return {n: self.store.table(f"{which}_{n}") for n in ("points", "images", "cameras", "observations")}

    def errors(self, which: str | None = None) -> DataFrame:
        r = self.reconstruction(which)
        return observations.observation_errors(r["observations"], r["points"].select("point_id", "x", "y", "z"), r["images"].select("image_id", "camera_id", "r", "t"), r["cameras"])

    def points(self) -> DataFrame:
        return self.reconstruction()["points"].orderBy("point_id")

    def cameras(self) -> DataFrame:
        r = self.reconstruction()
        return r["images"].join(r["cameras"], "camera_id").orderBy("name")

    def info(self) -> DataFrame:
        """name, registered: images of the base, and whether the current reconstruction has them."""
        base, now = self.reconstruction("base")["images"], self.reconstruction()["images"].filter("has_pose").select("image_id", F.lit(True).alias("registered"))
        return base.join(now, "image_id", "left").select("name", F.coalesce("registered", F.lit(False)).alias("registered")).orderBy("name")

    def tiepoint_stats(self, top: int = 300) -> dict[str, DataFrame]:
        """Tables of a tie point report; the sweep is of the base without deleted points."""
        now, base = self.errors(), self.errors("base")
        gone = self.spark.createDataFrame([(i,) for i in self.edits()["deleted_points"]], "point_id long")
        sweep = observations.threshold_sweep(base, gone)
        return {"summary": observations.reproj_stats(now), "worst": observations.worst_points(now, top), "per_image": observations.per_image(now), "thresholds": sweep, "recommended": observations.recommended_threshold(sweep), "histogram": observations.error_histogram(now), "map_points": observations.map_points(now, top)}

    def predict(self, x: float, y: float, z: float) -> DataFrame:
        """Where a ground point lies in the posed images: (image_id, name, u, v, from_centre), nearest to the centre first."""
        from ..functions.camera import in_image, project

        r = self.reconstruction()
        rows = r["images"].filter("has_pose").join(r["cameras"], "camera_id")
        u, v = project(F.col("lens"), F.col("r"), F.col("t"), F.lit(x), F.lit(y), F.lit(z))
        rows = rows.withColumns({"u": u, "v": v}).filter(in_image(F.col("u"), F.col("v"), F.col("width"), F.col("height")))
        return rows.select("image_id", "name", "u", "v", F.hypot(F.col("u") - F.col("width") / 2, F.col("v") - F.col("height") / 2).alias("from_centre")).orderBy("from_centre", "image_id")

    def camera(self, image: str) -> DataFrame:
        """The posed image of a name with its lens and size, one row; KeyError where there is none."""
        r = self.reconstruction()
        found = r["images"].filter(F.col("has_pose") & (F.col("name") == image)).join(r["cameras"], "camera_id").limit(1)
        if found.isEmpty():
            raise KeyError(image)
        return found

    def ground_to_image(self, image: str, points: DataFrame) -> DataFrame:
        """points (x, y, z) with their pixel u, v in an image; null behind the camera, outside of the frame as it falls."""
        from ..functions.camera import project

        one = self.camera(image).select("lens", "r", "t")
        u, v = project(F.col("lens"), F.col("r"), F.col("t"), F.col("x"), F.col("y"), F.col("z"))
        return points.crossJoin(F.broadcast(one)).select(*points.columns, u.alias("u"), v.alias("v"))  # one row beside each point

    def image_rays(self, image: str, pixels: DataFrame) -> DataFrame:
        """pixels (u, v) with the camera's centre ox, oy, oz and the unit direction dx, dy, dz of their rays."""
        from ..functions.camera import centre, ray

        one = self.camera(image).select("lens", F.array(*centre(F.col("r"), F.col("t"))).alias("o"), "r")
        both = pixels.crossJoin(F.broadcast(one)).withColumn("d", ray(F.col("lens"), F.col("r"), F.col("u"), F.col("v")))  # one row beside each pixel
        return both.select(*pixels.columns, *(F.col(k)[i].alias(f"{k}{c}") for k in "od" for i, c in enumerate("xyz")))

    def image_to_ground(self, image: str, pixels: DataFrame, z: float | None = None) -> DataFrame:
        """pixels (pixel_id, u, v) with x, y, z: where their rays meet the level z, or without one the workspace's surface."""
        from ..functions.camera import on_plane

        found = self.image_rays(image, pixels)
        if z is not None:
            x, y, level = on_plane([F.col("ox"), F.col("oy"), F.col("oz")], F.array("dx", "dy", "dz"), F.lit(float(z)))
            return found.select("pixel_id", x.alias("x"), y.alias("y"), level.alias("z"))
        if not self.store.exists("tables/surface"):
            raise ProjectError("the workspace has no surface", "not_rendered")
        cells, grid = self.store.table("surface"), self.store.get("surface")
        grids = self.spark.createDataFrame([("", *(grid[c] for c in ("x0", "y0", "res", "rows", "cols")))], "survey string, x0 double, y0 double, res double, rows int, cols int")
        met = rays.on_surface(found.withColumn("survey", F.lit("")).withColumnRenamed("pixel_id", "ray_id"), cells.withColumn("survey", F.lit("")), grids)
        return met.select(F.col("ray_id").alias("pixel_id"), "x", "y", "z")

    def set_surface(self, cells: DataFrame, x0: float, y0: float, res: float, rows: int, cols: int) -> None:
        """Keeps a surface (row, col, z; x0, y0 at the first cell's centre, rows downward) for rays and rendering."""
        refuse(not res > 0 or rows < 1 or cols < 1, "a surface has cells")
        self.store.delete("tables/surface_dry")
        self.store.write("surface", cells.select("row", "col", "z"))
        self.store.put("surface", {"x0": float(x0), "y0": float(y0), "res": float(res), "rows": int(rows), "cols": int(cols)})

    # ---- water ----

    def set_water_masks(self, masks: DataFrame | None) -> None:
        """Keeps masks (image: a photo's name, v, u, mask) of one's own, which detection leaves alone; None drops them."""
        self.store.delete("tables/masks")
        self.store.delete("docs/masks")
        if masks is not None:
            self.store.write("masks", water.normalize_masks(masks.select(F.lit("").alias("survey"), "image", "v", "u", "mask")).select("image", "v", "u", "mask"))
            self.store.put("masks", {"source": "user"})

    def water_masks(self) -> DataFrame | None:
        return self.store.table("masks") if self.store.exists("tables/masks") else None

    def detect_water(self, images: DataFrame, **how) -> None:
        """Masks of decoded images (Spark's image source), unless there are some of one's own."""
        if (self.store.get("masks") or {}).get("source") != "user":
            self.store.write("masks", waterimage.detect(images, "", **how).select("image", "v", "u", "mask"))
            self.store.put("masks", {"source": "auto"})

    def treat_water(self, mode: str = "auto", tile: float = 64.0) -> dict:
        """Levels the surface under water that the masks of the posed photos vote for, and tells what was done.

        mode: on, off, or auto (by the masks' share of water). The surface before is kept, so that treating again starts from it.
        """
        refuse(mode.strip().lower() not in water.MODES, f"mode is one of {', '.join(water.MODES)}")
        mode, grid, masks = mode.strip().lower(), self.store.get("surface"), self.water_masks()
        if grid is None:
            raise ProjectError("the workspace has no surface", "not_rendered")
        if not self.store.exists("tables/surface_dry"):
            self.store.write("surface_dry", self.store.table("surface"))
        dry = self.store.table("surface_dry")
        self.store.write("surface", dry)
        info = {"mode": mode, "source": (self.store.get("masks") or {}).get("source"), "active": False, "bodies": []}
        photos = self.reconstruction()["images"].filter("has_pose").select("image_id", F.col("name").alias("image"))
        if masks is not None and mode != "off":
            mine = water.masks_of(masks.withColumn("survey", F.lit("")), photos.withColumn("survey", F.lit("")))
            found = water.summarize(mine).first()
            if found is not None:
                info |= {"fraction": round(found.fraction, 6), "images_with_water": found.images_with_water}
                info["active"] = self.spark.range(1).select(water.decided(F.lit(mode), F.lit(found.fraction))).first()[0]
        if info["active"]:
            size = mine.groupBy("image").agg((F.max("v") + 1).alias("mask_rows"), (F.max("u") + 1).alias("mask_cols")).join(photos, "image")
            r = self.reconstruction()
            seen = self.look(tile).join(size.withColumnRenamed("image_id", "view"), "view")
            at = lambda c, n, full: F.least(F.floor(F.col(c) * F.col(n) / F.col(full)), F.col(n) - 1).cast("int")
            seen = seen.select("survey", "row", "col", "view", "image", at("v", "mask_rows", "height").alias("mv"), at("u", "mask_cols", "width").alias("mu"))
            voted = water.cell_votes(seen.join(mine.select("image", F.col("v").alias("mv"), F.col("u").alias("mu"), "mask"), ["image", "mv", "mu"]))
            cells = dry.select(F.lit("").alias("survey"), "row", "col").join(voted.select("survey", "row", "col", "candidate"), ["survey", "row", "col"], "left").withColumn("candidate", F.coalesce("candidate", F.lit(False)))
            place = lambda d: F.floor(d / grid["res"] + 0.5).cast("int")
            points = r["points"].select(F.lit("").alias("survey"), place(F.lit(grid["y0"]) - F.col("y")).alias("row"), place(F.col("x") - F.lit(grid["x0"])).alias("col"), "z")
            labelled = self.store.write("water_cells", water.label_cells(cells))
            # stored, since what they are made from reads the surface that is replaced below
            bodies = self.store.write("water_bodies", water.water_bodies(labelled, water.point_density(points, cells), points, grid["res"])).filter("accepted")
            wet = labelled.join(bodies, ["survey", "label"]).select("survey", "row", "col", "level")
            self.store.write("surface", surface.flatten(dry.withColumn("survey", F.lit("")), wet).select("row", "col", "z"))
            info["bodies"] = [{"label": b.label, "cells": b.cells, "level_m": b.level, "area_m2": b.cells * grid["res"] ** 2} for b in water.largest_bodies(bodies).orderBy("place").collect()]
        self.store.put("water", info)
        return info

    # ---- edits ----

    def edits(self) -> dict:
        return {**EDITS, **(self.store.get("edits") or {})}

    def set_edits(self, *, gcps=UNSET, tiepoints=UNSET, max_reproj_error_px=UNSET, deleted_points=UNSET) -> dict:
        """Replaces the given parts. Bad values are refused as invalid_edits."""
        e = self.edits()
        mark = lambda o: {"image": str(o["image"]), "x": float(o["x"]), "y": float(o["y"])}
        try:
            if deleted_points is not UNSET:
                e["deleted_points"] = sorted({int(i) for i in deleted_points})
            if max_reproj_error_px is not UNSET:
                e["max_reproj_error_px"] = None if max_reproj_error_px is None else float(max_reproj_error_px)
                if e["max_reproj_error_px"] is not None and not e["max_reproj_error_px"] > 0:
                    raise ValueError("max_reproj_error_px is positive")
            if tiepoints is not UNSET:
                e["tiepoints"] = [{"id": str(t["id"]), "obs": [mark(o) for o in t.get("obs", [])]} for t in tiepoints]
            if gcps is not UNSET:
                e["gcps"] = [{"name": str(g["name"]), **{k: float(g[k]) for k in "xyz"}, "epsg": geodesy.crs(int(g["epsg"])).epsg, "role": "check" if g.get("role") == "check" else "control", "obs": [mark(o) for o in g.get("obs", [])]} for g in gcps]
        except (KeyError, TypeError, ValueError, InputError) as x:
            raise InputError(f"edits can't be used: {x}", "invalid_edits") from x
        self.store.put("edits", e)
        return e

    def refine(self, report: Reporter | None = None) -> dict:
        """From the base: deleted points go, large errors go, points settle between fixed cameras; always the same for the same edits."""
        report = report or Reporter()
        if not self.store.exists("tables/base_points"):
            raise ProjectError("the workspace has no reconstruction", "not_aligned")
        report.stage("refine", "filters")
        e, base = self.edits(), self.reconstruction("base")
        gone = self.spark.createDataFrame([(i,) for i in e["deleted_points"]], "point_id long")
        obs = base["observations"].join(gone, "point_id", "left_anti")
        before = observations.reproj_stats(self.errors("base")).first().asDict()
        if e["max_reproj_error_px"] is not None:
            good = observations.filter_large_errors(self.errors("base").join(gone, "point_id", "left_anti"), e["max_reproj_error_px"])
            obs = obs.join(good.select("point_id", "image_id", "p2d_idx"), ["point_id", "image_id", "p2d_idx"], "left_semi")
        points = base["points"].join(obs.select("point_id").distinct(), "point_id", "left_semi")
        lens = base["cameras"].select("camera_id", *(F.col(f"lens.{k}").alias(k) for k in ("fx", "fy", "cx", "cy")))
        rays = obs.join(base["images"].filter("has_pose").select("image_id", "camera_id", "r", "t"), "image_id").join(lens, "camera_id")
        moved = sfm.adjust_points(rays, points.select("point_id", "x", "y", "z"))
        others = [c for c in points.columns if c not in ("x", "y", "z")]
        points = points.select(*others).join(moved, "point_id")
        for name, df in (("points", points), ("observations", obs), ("images", base["images"]), ("cameras", base["cameras"])):
            self.store.write(f"refined_{name}", df)
        after = observations.reproj_stats(self.errors("refined")).first().asDict()
        out = {"report_version": REPORT_VERSION, "datum": "base", "before": before, "after": after}
        self.store.put("refine", out)
        return out

    def reset_refinement(self) -> None:
        """Drops refinements; edits stay."""
        for n in ("points", "observations", "images", "cameras"):
            self.store.delete(f"tables/refined_{n}")
        self.store.delete("docs/refine")

    # ---- products ----

    def look(self, tile: float = 64.0) -> DataFrame:
        """(row, col, view, u, v, r, x, y) of every cell of the surface in every photo that shows it: what a mosaic is sampled by."""
        r, grid = self.reconstruction(), self.store.get("surface")
        if grid is None:
            raise ProjectError("the workspace has no surface", "not_rendered")
        cells = self.store.table("surface").select(F.lit("").alias("survey"), "row", "col", (F.lit(grid["x0"]) + F.col("col") * grid["res"]).alias("x"), (F.lit(grid["y0"]) - F.col("row") * grid["res"]).alias("y"), "z")
        level = F.lit(cells.agg(F.median("z")).first()[0])
        images = r["images"].filter("has_pose").join(r["cameras"], "camera_id").select(F.lit("").alias("survey"), "image_id", "width", "height", "lens", "r", "t")
        return rays.looks(cells, rays.views(images, level), tile)

    def render_photos(self, photos: DataFrame, channels: list[str], temperature: float, tile: float = 64.0, report: Reporter | None = None) -> DataFrame:
        """Mosaic of the surface's cells from photos (view: the image_id, prow, pcol and channels)."""
        seen = rays.sampled(self.look(tile), photos.withColumn("survey", F.lit("")), channels)
        return self.render(seen, channels, temperature, report=report)

    def render(self, samples: DataFrame, channels: list[str], temperature: float, options: GridOptions | None = None, native_gsd: float = 1.0, report: Reporter | None = None) -> DataFrame:
        """Mosaic of samples (survey, view, r, channels) under seam weights. Samples have row and col, or x and y that the options' grid
        takes; options and grid are remembered."""
        document = (options or GridOptions()).stored()
        if "row" in samples.columns:
            refuse(options is not None, "samples with rows and columns have their grid already")
        else:
            document["grid"] = (options or GridOptions()).georeference(samples, native_gsd)
            samples = gridded(samples, document["grid"])
        (report or Reporter()).stage("mosaic", "seams")
        out = self.store.write("mosaic", mosaic.blend(mosaic.with_seam_weights(samples, F.lit(float(temperature))), channels))
        self.store.put("render", document)
        return out

    def mosaic(self) -> DataFrame:
        if not self.store.exists("tables/mosaic"):
            raise ProjectError("the workspace has no mosaic", "not_rendered")
        return self.store.table("mosaic")

    def overviews(self, value: str, size: int) -> list[DataFrame]:
        return surface.pyramid(self.mosaic(), value, size)

    def make_indices(self, bands: dict[str, str], selected: list[str] | None = None) -> DataFrame:
        """Index columns of the mosaic's bands (name to column); replaces older ones as a whole."""
        if not bands:
            raise ProjectError("the mosaic has no bands", "not_multispectral")
        pixels = self.mosaic()
        keep = [c for c in ("survey", "row", "col") if c in pixels.columns]
        done = indices.with_indices(pixels, bands, selected)
        names = [n.lower() for n in indices.normalised_selection(selected) if n.lower() in done.columns]
        return self.store.write("indices", done.select(*keep, *names))

    def report(self) -> dict:
        """Align, render and refine reports in one; warnings each once and in order."""
        parts = {k: self.store.get(k) for k in ("align", "preview", "water", "render", "refine")}
        said = [w for p in parts.values() if p for w in p.get("warnings", [])]
        return {"report_version": REPORT_VERSION, **{k: v for k, v in parts.items() if v}, "warnings": list(dict.fromkeys(said))}


def version_of(spark: SparkSession, text: str) -> tuple[int, int, int]:
    return tuple(spark.range(1).select(version_parts(F.lit(text)).alias("v")).first().v)


def safe_name(name: str) -> str:
    """A relative file name without ways out of its folder."""
    if re.search(r"(^|[/\\])\.\.([/\\]|$)|^[/\\]|^\w:", name):
        raise InputError(f"{name} leaves its folder", "invalid_argument")
    return name
