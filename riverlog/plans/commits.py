"""What a job has delivered: one committed snapshot of marks per batch.

A mark is the place up to which a file of a source was delivered, with the
watermark text of the entry there.  A commit writes the marks of all files known
so far as a table beside the log, and then makes them valid by one atomic rename
of a small record whose name is the batch: either the batch is delivered or it is
not, and a batch committed twice is recognised.  A crash before the rename leaves
a table that nothing refers to and the next commit of that batch replaces.

Folders go through Spark's own file systems; any store with an atomic rename
that fails on existing names will do (local disks, HDFS).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverlog.functions.timestamps import watermark_text
from riverlog.model import require

PLACE = ("source", "file")
_MARKS = "source string, file string, position bigint, watermark string, batch bigint"
# Commits, and their tables, that stay readable behind the newest.
KEEP = 10


class CommitLog:
    """The commits of one job under ``path``, shared by driver and executors."""

    def __init__(self, spark: SparkSession, path: str, job: str = "job") -> None:
        require(path != "" and job != "", "commit log: a path and a job name are required")
        self.spark, self.root = spark, f"{path.rstrip('/')}/{job}"
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/commits")
        if not self._fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in self._fs.listStatus(folder)]
        return sorted(int(name.removesuffix(".json")) for name in names if name.endswith(".json"))

    def latest(self) -> int | None:
        versions = self.versions()
        return versions[-1] if versions else None

    def committed(self, batch_id: int) -> bool:
        latest = self.latest()
        return latest is not None and batch_id <= latest

    def marks(self) -> DataFrame:
        """``source, file, position, watermark, batch`` as last committed."""
        latest = self.latest()
        if latest is None:
            return self.spark.createDataFrame([], _MARKS)
        record = self.spark.read.text(self._record(latest), wholetext=True).first()["value"]
        return self.spark.read.schema(_MARKS).parquet(f"{self.root}/{json.loads(record)['marks']}")

    def watermarks(self) -> DataFrame:
        """Per source the watermark of the last entry of its newest batch."""
        newest = F.max_by("watermark", F.struct("batch", "file", "position"))
        return self.marks().groupBy("source").agg(newest.alias("watermark"))

    def commit(self, batch_id: int, delivered: DataFrame) -> bool:
        """Make ``delivered`` (entries with ``source, file, pos``) part of what is
        done.  False if the batch was committed before."""
        if self.committed(batch_id):
            return False
        fresh = delivered.groupBy(*PLACE).agg(
            F.max("pos").alias("position"),
            watermark_text(F.max_by("timestamp", "pos")).alias("watermark"),
            F.lit(batch_id).cast("bigint").alias("batch"),
        )
        columns = F.struct("position", "watermark", "batch")
        merged = self.marks().unionByName(fresh).groupBy(*PLACE).agg(F.max_by(columns, "batch").alias("mark"))
        table = f"marks/{batch_id}-{uuid.uuid4().hex}"
        merged.select(*PLACE, "mark.*").write.parquet(f"{self.root}/{table}")
        return self._publish(batch_id, {"batch": batch_id, "marks": table})

    def _record(self, batch_id: int) -> str:
        return f"{self.root}/commits/{batch_id:020d}.json"

    def _publish(self, batch_id: int, record: dict) -> bool:
        staged, final = self._path(f"{self.root}/staged/{uuid.uuid4().hex}"), self._path(self._record(batch_id))
        out = self._fs.create(staged, False)
        out.write(bytearray(json.dumps(record).encode()))
        out.close()
        self._fs.mkdirs(final.getParent())
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        # without options an existing name is an error, on every store
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._fs.makeQualified(staged), self._fs.makeQualified(final), options)
        except Exception:
            self._fs.delete(staged, False)
            if self._fs.exists(final):
                return False
            raise
        self._forget(batch_id)
        return True

    def _forget(self, newest: int) -> None:
        """Drop records and tables far behind the newest commit."""
        versions = self.versions()
        for old in versions[:-KEEP]:
            self._fs.delete(self._path(self._record(old)), False)
        kept = set(versions[-KEEP:])
        folder = self._path(f"{self.root}/marks")
        for status in self._fs.listStatus(folder):
            batch = int(status.getPath().getName().split("-")[0])
            if batch < newest and batch not in kept:
                self._fs.delete(status.getPath(), True)


def undelivered(entries: DataFrame, log: CommitLog, by: Sequence[str] = PLACE) -> DataFrame:
    """Entries behind the mark of their file, and all of files without one."""
    known = log.marks().select(*[F.col(name).alias(f"_{name}") for name in by], F.col("position").alias("_mark"))
    same = F.lit(True)
    for name in by:
        same = same & entries[name].eqNullSafe(known[f"_{name}"])
    joined = entries.join(known, same, "left")
    return joined.where(F.col("_mark").isNull() | (F.col("pos") > F.col("_mark"))).select(entries.columns)
