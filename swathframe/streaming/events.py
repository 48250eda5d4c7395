"""Events of long operations, cancelling, and a line protocol of jobs; live coverage as shots arrive."""

from __future__ import annotations

import json
import sys
import threading
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Cancelled, InputError, SurveyError


@dataclass(frozen=True)
class Event:
    """A stage's start, progress, or a log line."""

    type: str
    stage: str | None = None
    message: str = ""
    current: int | None = None
    total: int | None = None
    level: str | None = None

    @property
    def fraction(self) -> float | None:
        """Progress from 0 to 1."""
        if self.type != "progress" or not self.total:
            return None
        return max(0.0, min(1.0, (self.current or 0) / self.total))


class CancelToken:
    """A flag that any thread may set; operations look at it whenever they report. A Spark job group ends with it."""

    def __init__(self):
        self._set, self._groups = threading.Event(), []

    def cancel(self) -> None:
        self._set.set()
        for sc, group in self._groups:
            sc.cancelJobGroup(group)

    def watch(self, sc, group: str) -> None:
        self._groups.append((sc, group))
        sc.setJobGroup(group, group, True)

    @property
    def cancelled(self) -> bool:
        return self._set.is_set()

    def check(self) -> None:
        if self.cancelled:
            raise Cancelled("cancelled on request")


class Reporter:
    """Calls back with events and stops once its token is set."""

    def __init__(self, on_event: Callable[[Event], None] | None = None, cancel: CancelToken | None = None):
        self.on_event, self.cancel, self._stage = on_event, cancel, None

    def _send(self, event: Event) -> None:
        if self.cancel:
            self.cancel.check()
        if self.on_event:
            self.on_event(event)

    def stage(self, name: str, message: str = "") -> None:
        self._stage = name
        self._send(Event("stage", name, message))

    def progress(self, current: int, total: int) -> None:
        self._send(Event("progress", self._stage, current=current, total=total))

    def log(self, message: str, level: str = "info") -> None:
        self._send(Event("log", None, message, level=level))


def print_progress(event: Event) -> None:
    """A console's view of events, in steps of a tenth."""
    if event.type == "stage":
        print(f"[{event.stage}] {event.message}", flush=True)
    elif event.type == "log":
        print(f"{event.level}: {event.message}", flush=True)
    elif event.total and event.current is not None and (event.current == event.total or event.current % max(1, event.total // 10) == 0):
        print(f"[{event.stage}] {event.current}/{event.total}", flush=True)


def serve(commands: dict[str, Callable[[dict, Reporter], object]], stdin=None, stdout=None) -> None:
    """Reads one JSON request a line ({"job", "command", ...}), runs them in turn, writes JSON events tagged with the job, then "done".
    A bad line or a failed command is an error event; the loop goes on."""
    stdin, stdout = stdin or sys.stdin, stdout or sys.stdout

    def say(job, **what):
        print(json.dumps({"job": job, **what}, ensure_ascii=False), file=stdout, flush=True)

    for line in stdin:
        if not line.strip():
            continue
        job = None
        try:
            request = json.loads(line)
            if not isinstance(request, dict):
                raise InputError("a request is an object", "invalid_argument")
            job, command = request.get("job"), request.get("command")
            if command not in commands:
                raise InputError(f"unknown command {command}", "invalid_argument")
            report = Reporter(lambda e, job=job: say(job, **{k: v for k, v in vars(e).items() if v is not None}))
            say(job, type="result", data=commands[command](request, report))
        except json.JSONDecodeError as e:
            say(job, type="error", code="invalid_request", message=str(e))
        except SurveyError as e:
            say(job, type="error", code=e.code, message=str(e))
        except Exception as e:  # noqa: BLE001  a command's failure doesn't end the loop
            say(job, type="error", code="internal_error", message=f"{type(e).__name__}: {e}")
        say(job, type="done")


def live_coverage(cells: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Counts of footprints by cell and day from a stream of (survey, row, col, ts); shots later than `late` are left out."""
    return cells.withWatermark("ts", late).groupBy(F.window("ts", window).alias("day"), "survey", "row", "col").agg(F.count("*").alias("n")).select("survey", "row", "col", F.col("day.start").alias("day"), "n")
