"""Tables written between the rounds of an iteration, to cut lineage: they lie in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder only where none is set."""
    sc = spark.sparkContext
    have = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not have:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        have = tempfile.mkdtemp(prefix="swathframe-")
        sc.setCheckpointDir(have)
    return have.rstrip("/")


class Rounds:
    """keep(df) writes a round's table and reads it back; the tables go when the process ends.

    last: so many tables stay, older ones go when a new one is written.
    """

    def __init__(self, spark: SparkSession, last: int | None = None):
        self.spark, self.root, self.n, self.last = spark, f"{shared_dir(spark)}/rounds-{uuid.uuid4().hex}", 0, last
        atexit.register(self.drop)

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.root}/{self.n}")
        if self.last and self.n > self.last:
            self.drop(f"/{self.n - self.last}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{self.n}")

    def drop(self, table: str = "") -> None:
        try:
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root + table)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass
