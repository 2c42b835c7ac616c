"""A log of small writes that is folded into ever larger segments, for tables that take a few rows at a time.

A segment is a folder of Parquet files named by its tier and the batches it covers; it counts when its ``_SUCCESS`` file is
there, so a job that dies leaves nothing half visible. FANOUT segments of a tier are folded into one of the next. The segments
that a fold replaces stay until the next fold, for readers that have listed them already. One writer per log is assumed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .readers import empty

#: Segments of a tier that are folded.
FANOUT = 8


@dataclass(frozen=True, order=True)
class Segment:
    tier: int
    first: int
    last: int

    @property
    def folder(self) -> str:
        return f"segment-{self.tier}-{self.first}-{self.last}"

    def covers(self, other: Segment) -> bool:
        return self.tier > other.tier and self.first <= other.first and other.last <= self.last


class SegmentLog:
    """The segments under a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _files(self):
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder, folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _complete(self) -> list[Segment]:
        folder, files = self._files()
        if not files.exists(folder):
            return []
        Path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        names = [f.getPath().getName() for f in files.listStatus(folder) if f.isDirectory()]
        found = [Segment(*map(int, n.split("-")[1:])) for n in names if n.startswith("segment-")]
        return sorted(s for s in found if files.exists(Path(f"{self.path}/{s.folder}/_SUCCESS")))

    def segments(self) -> list[Segment]:
        """What a reader reads: complete segments that no larger one covers."""
        found = self._complete()
        return [s for s in found if not any(o.covers(s) for o in found)]

    def holds(self, batch: int) -> bool:
        """Whether a batch was folded, or written whole."""
        return any(s.first <= batch <= s.last for s in self.segments())

    def write(self, rows: DataFrame, tier: int, first: int, last: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{Segment(tier, first, last).folder}")

    def read(self, schema: StructType, some: list[Segment] | None = None) -> DataFrame:
        which = self.segments() if some is None else some
        if not which:
            return empty(self.spark, schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{s.folder}" for s in which])

    def compact(self, fold: Callable[[DataFrame], DataFrame]) -> None:
        """Fold each tier that has FANOUT segments, from the lowest on; drop what earlier folds replaced."""
        replaced = [s for s in self._complete() if s not in self.segments()]
        tier, folds = 0, 0
        while True:
            own = [s for s in self.segments() if s.tier == tier]
            if len(own) < FANOUT:
                break
            schema = self.spark.read.parquet(f"{self.path}/{own[0].folder}").schema
            self.write(fold(self.read(schema, own)), tier + 1, own[0].first, own[-1].last)
            tier, folds = tier + 1, folds + 1
        if folds:
            folder, files = self._files()
            Path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
            for s in replaced:
                files.delete(Path(f"{self.path}/{s.folder}"), True)
