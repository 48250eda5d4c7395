"""Command line: python -m swathframe.plans.cli COMMAND. Exit codes: 0 done, 1 failed, 2 bad arguments."""

from __future__ import annotations

import argparse
import json
import shutil
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..errors import SurveyError
from ..functions import indices
from ..operators import scan
from ..sources import control, photos
from ..streaming.events import Reporter, print_progress, serve
from .options import PreviewOptions
from .workspace import Project


def session() -> SparkSession:
    spark = SparkSession.builder.appName("swathframe").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="swathframe")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *names: str, **flags):
        p = sub.add_parser(name)
        for n in names:
            p.add_argument(n)
        for n, kind in flags.items():
            p.add_argument(f"--{n.replace('_', '-')}", **({"action": "store_true"} if kind is bool else {"type": kind}))

    add("scan", "folder", recursive=bool)
    add("create", "folder", "workspace", recursive=bool)
    add("preview", "workspace", max_size=int, epsg=int)
    add("info", "workspace")
    add("report", "workspace")
    add("tiepoints", "workspace", top=int)
    add("edits", "workspace")
    add("set-edits", "workspace", "document")
    add("refine", "workspace")
    add("reset", "workspace")
    add("indices", bands=str)
    add("look", "file", encoding=str, delimiter=str)
    add("points", "file", "epsg")
    add("doctor")
    add("serve")
    return top


def scanned(spark: SparkSession, a) -> dict:
    shots, failed = photos.scan_folder(spark, a["folder"], bool(a.get("recursive")))
    row = scan.scan_summary(scan.with_selection(shots)).first()
    return {"summary": row.asDict() if row else {}, "cameras": [r.asDict() for r in scan.camera_groups(shots).collect()], "failed": [r.asDict() for r in failed.limit(100).collect()]}


def doctor(spark: SparkSession) -> dict:
    """What the engine needs, and whether it is here."""
    import numpy
    import pyarrow

    disk = shutil.disk_usage(".")
    ok = spark.range(10).select(F.sum("id")).first()[0] == 45
    return {"spark": spark.version, "java": spark.sparkContext._jvm.System.getProperty("java.version"), "numpy": numpy.__version__, "pyarrow": pyarrow.__version__, "works": ok, "free_gb": round(disk.free / 1e9, 1)}


def run(command: str, a: dict, report: Reporter, spark: SparkSession | None = None):
    """The command's result, as plain data."""
    spark = spark or session()
    opened = lambda: Project.open(spark, a["workspace"])
    if command == "scan":
        return scanned(spark, a)
    if command == "create":
        Project.create(photos.scan_folder(spark, a["folder"], bool(a.get("recursive")))[0], a["workspace"])
        return {"workspace": a["workspace"]}
    if command == "preview":
        return Project(spark, a["workspace"]).preview(PreviewOptions(max_size=int(a.get("max_size") or 2048)), a.get("epsg"), report)
    if command == "info":
        return [r.asDict() for r in opened().info().collect()]
    if command == "report":
        return Project(spark, a["workspace"]).report()
    if command == "tiepoints":
        tables = opened().tiepoint_stats(int(a.get("top") or 300))
        return {k: [r.asDict() for r in t.collect()] for k, t in tables.items() if k != "map_points"}
    if command == "edits":
        return opened().edits()
    if command == "set-edits":
        d = a["document"] if isinstance(a["document"], dict) else json.loads(a["document"])
        return opened().set_edits(**{k: v for k, v in d.items() if k != "version"})
    if command == "refine":
        return opened().refine(report)
    if command == "reset":
        return opened().reset_refinement()
    if command == "indices":
        return [r.asDict() for r in indices.catalog(spark, (a.get("bands") or "").split(",")).collect()]
    if command == "look":
        with open(a["file"], "rb") as f:
            seen = control.look(f.read(), a.get("encoding"), a.get("delimiter"))
        return {"encoding": seen.encoding, "delimiter": seen.delimiter, "header": seen.header, "guess": seen.guess, "rows": seen.rows[:5]}
    if command == "points":
        return [r.asDict() for r in control.load_points(spark, a["file"], int(a["epsg"])).collect()]
    return doctor(spark)


COMMANDS = ("scan", "create", "preview", "info", "report", "tiepoints", "edits", "set-edits", "refine", "reset", "indices", "look", "points", "doctor")


def main(argv: list[str] | None = None) -> int:
    a = vars(parser().parse_args(argv))
    command = a.pop("command")
    try:
        if command == "serve":
            spark = session()
            serve({c: lambda request, report, c=c: run(c, request, report, spark) for c in COMMANDS})
        else:
            print(json.dumps(run(command, a, Reporter(print_progress)), ensure_ascii=False, default=str, indent=1))
    except SurveyError as e:
        print(json.dumps({"type": "error", "code": e.code, "message": str(e)}, ensure_ascii=False), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
