"""Log files as batch tables of lines."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverlog.sources.tail import LineFiles


@dataclass(frozen=True)
class Source:
    path: str
    label: str | None = None


def read_logs(
    spark: SparkSession,
    paths: str | Sequence[str],
    label: str | None = None,
    with_position: bool = False,
    frozen: bool = False,
) -> DataFrame:
    """Lines of newline-delimited files: ``value`` and ``source``.

    Globs are allowed and large files are split over tasks.  ``source`` is the
    label, else the path of the file.  ``with_position`` adds ``file`` and
    ``pos``, the byte at which a line starts: an arrival order for operators
    that need one (files must then be visible to all executors by path).  With
    ``frozen`` it reads the whole lines that are there now, in every run.
    """
    wanted = [paths] if isinstance(paths, str) else list(paths)
    if with_position:
        spark.dataSource.register(LineFiles)
        lines = spark.read.format(LineFiles.name()).options(**LineFiles.encode(wanted, frozen=frozen)).load()
        return lines.select(
            "value", (F.col("file") if label is None else F.lit(label)).alias("source"), "file", "pos"
        )
    origin = F.col("_metadata.file_path") if label is None else F.lit(label)
    return spark.read.text(wanted).select("value", origin.alias("source"))


def union_sources(
    spark: SparkSession, sources: Sequence[Source], with_position: bool = False
) -> tuple[DataFrame, list[Source]]:
    """All sources as one table of lines, and those that could not be opened.

    Sources with the same label, or without one, share a scan.  With positions
    the whole lines that are there now are read, in every run of the plan.
    """
    by_label: dict[str | None, list[str]] = {}
    skipped: list[Source] = []
    for source in sources:
        try:
            spark.read.text(source.path)
        except AnalysisException:
            skipped.append(source)
        else:
            by_label.setdefault(source.label, []).append(source.path)
    scans = [
        read_logs(spark, paths, label, with_position, frozen=with_position) for label, paths in by_label.items()
    ]
    if not scans:
        places = ", file string, pos bigint" if with_position else ""
        return spark.createDataFrame([], "value string, source string" + places), skipped
    return functools.reduce(DataFrame.unionByName, scans), skipped
