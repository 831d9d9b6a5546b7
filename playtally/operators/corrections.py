"""Conditional bulk updates of stored tables."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playtally.functions import in_list
from playtally.sources.tables import write_table


@dataclass(frozen=True)
class Correction:
    """Set ``column`` to ``value`` in rows of the days and brands that pass a test."""

    column: str
    value: object
    first_day: dt.date
    last_day: dt.date
    brands: Sequence[str]
    condition: Column | None = None

    @property
    def predicate(self) -> Column:
        test = F.col("event_date").between(self.first_day, self.last_day) & in_list(
            F.col("brand"), self.brands
        )
        return test if self.condition is None else test & self.condition


def correct(summary: DataFrame, corrections: Sequence[Correction]) -> DataFrame:
    """Apply corrections one after the other; an unknown test changes nothing."""
    for one in corrections:
        summary = summary.withColumn(
            one.column, F.when(one.predicate, F.lit(one.value)).otherwise(F.col(one.column))
        )
    return summary


def correct_table(
    spark: SparkSession,
    path: str,
    staging_path: str,
    corrections: Sequence[Correction],
    partition_column: str = "event_date",
) -> None:
    """Apply a set of corrections once to every row of a table on disk.

    Only files of the days that the corrections name are rewritten, and of those
    only files that this set has not written itself: what it wrote is on record
    below ``staging_path``, by a fingerprint of the set. So a repeated run changes
    nothing, and rows that came since are corrected by the next one.

    All corrected files are complete, and a plan of the swap is written, before the
    first old file goes. A run that finds such a plan, of this set or of another,
    carries it through first: its steps can be repeated. Readers of a day may see
    old and new files together while that day is swapped. Keep one staging path
    for a table, on its file system.
    """
    files = _Files(spark, path, staging_path, partition_column)
    files.finish_swaps()
    mark = _fingerprint(corrections)
    days = {day for one in corrections for day in _days(one.first_day, one.last_day)}
    current = files.of_days(days)
    written = files.written_by(mark)
    waiting = [name for name in current if name not in written]
    if not waiting:
        return
    table = spark.read.parquet(path)
    rows = (
        spark.read.schema(table.schema)
        .option("basePath", path)
        .parquet(*[f"{path}/{name}" for name in waiting])
    )
    write_table(correct(rows, corrections), files.staged(mark), partition_column, mode="overwrite")
    files.plan_swap(mark, waiting, [name for name in current if name in written])
    files.finish_swaps()


def _days(first: dt.date, last: dt.date) -> list[str]:
    return [(first + dt.timedelta(days=i)).isoformat() for i in range((last - first).days + 1)]


def _fingerprint(corrections: Sequence[Correction]) -> str:
    """Name of a set of corrections: the same for equal sets in any session."""
    parts = [
        [
            one.column, repr(one.value), str(one.first_day), str(one.last_day),
            list(one.brands), str(one.condition),
        ]
        for one in corrections
    ]
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()[:32]


class _Files:
    """The files of a partitioned table and of its staging folder; only names and plans are read."""

    def __init__(self, spark: SparkSession, path: str, staging_path: str, partition_column: str):
        self._path, self._staging, self._column = path, staging_path, partition_column
        self._jvm = spark._jvm
        self._system = self._place(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _place(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def staged(self, mark: str) -> str:
        return f"{self._staging}/{mark}"

    def of_days(self, days: set[str]) -> list[str]:
        """Names of the table's files of some days, as partition folder / file."""
        return [x for x in self._names(self._path) if x.split("/")[0].split("=", 1)[1] in days]

    def written_by(self, mark: str) -> set[str]:
        return set(self._read(f"{self._staging}/{mark}.done") or [])

    def plan_swap(self, mark: str, old: list[str], kept: list[str]) -> None:
        plan = {"old": old, "new": self._names(self.staged(mark)), "kept": kept}
        self._write(f"{self._staging}/{mark}.plan", plan)

    def finish_swaps(self) -> None:
        """Carry through every swap that is planned; each step may have been made before."""
        for status in self._system.globStatus(self._place(f"{self._staging}/*.plan")) or []:
            mark = status.getPath().getName().removesuffix(".plan")
            plan = self._read(f"{self._staging}/{mark}.plan")
            for day in sorted({name.split("/")[0] for name in plan["new"] + plan["old"]}):
                self._swap(mark, day, plan)
            self._write(f"{self._staging}/{mark}.done", plan["kept"] + plan["new"])
            self._system.delete(status.getPath(), False)
            self._system.delete(self._place(self.staged(mark)), True)

    def _swap(self, mark: str, day: str, plan: dict[str, list[str]]) -> None:
        self._system.mkdirs(self._place(f"{self._path}/{day}"))
        for name in plan["new"]:
            source, target = self._place(f"{self.staged(mark)}/{name}"), self._place(f"{self._path}/{name}")
            if name.startswith(f"{day}/") and not self._system.exists(target):
                if not self._system.rename(source, target):
                    raise OSError(f"cannot move {source} to {target}")
        for name in plan["old"]:
            if name.startswith(f"{day}/"):
                self._system.delete(self._place(f"{self._path}/{name}"), False)

    def _names(self, path: str) -> list[str]:
        found = self._system.globStatus(self._place(f"{path}/{self._column}=*/*.parquet")) or []
        return [f"{x.getPath().getParent().getName()}/{x.getPath().getName()}" for x in found]

    def _read(self, path: str):
        place = self._place(path)
        if not self._system.exists(place):
            return None
        stream = self._system.open(place)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _write(self, path: str, value: object) -> None:
        """Whole or not at all: a file gets its name when it is complete."""
        part = self._place(f"{path}.part")
        stream = self._system.create(part, True)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()
        self._system.delete(self._place(path), False)
        if not self._system.rename(part, self._place(path)):
            raise OSError(f"cannot write {path}")
