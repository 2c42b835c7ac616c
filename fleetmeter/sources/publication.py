"""Replacing day folders of a stored table so that a run that dies at any point can be finished or undone.

New days are written beside the table (names that begin with ``_`` are no rows to Spark). A small intent file then names the
days to swap in and those to drop; it appears by a rename, whole or not at all. Only after that are folders deleted and
renamed. The next writer looks for what a dead one left: with an intent it finishes the swap, every step of which may be
repeated; without one nothing was touched and the staged days are deleted. One writer per table is assumed. A folder's rename
must be one step in the file system; on stores that copy instead, the swap takes longer but recovers in the same way.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession

STAGING, INTENT, DRAFT = "_staged_days", "_intent", "_intent_draft"


class Folder:
    """The few file operations needed, on whatever file system the path is on."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str = ""):
        return self._path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._files.exists(self.at(name))

    def delete(self, name: str) -> None:
        self._files.delete(self.at(name), True)

    def rename(self, old: str, new: str) -> None:
        if not self._files.rename(self.at(old), self.at(new)):
            raise OSError(f"cannot rename {self.path}/{old} to {new}")

    def folders(self, name: str = "") -> list[str]:
        if not self.exists(name):
            return []
        return sorted(f.getPath().getName() for f in self._files.listStatus(self.at(name)) if f.isDirectory())

    def write(self, name: str, text: str) -> None:
        out = self._files.create(self.at(name), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, name: str) -> str:
        stream = self._files.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


def days_in(folder: Folder, name: str = "") -> list[date]:
    """The days that have a folder, by listing them."""
    return sorted(date.fromisoformat(n[4:]) for n in folder.folders(name) if n.startswith("day=") and n[4:5].isdigit())


def publish(spark: SparkSession, path: str, rows: DataFrame | None, drop: Iterable[date] = ()) -> None:
    """Replace the days that ``rows`` (with a column ``day``) have, and drop others.

    ``rows`` may be read from the table itself: nothing is replaced before all of it is written.
    """
    recover(spark, path)
    folder = Folder(spark, path)
    if rows is not None:
        rows.write.mode("overwrite").partitionBy("day").parquet(f"{folder.path}/{STAGING}")
    swap = days_in(folder, STAGING)
    gone = sorted(set(drop) - set(swap))
    if swap or gone:
        folder.write(DRAFT, json.dumps({"swap": [d.isoformat() for d in swap], "drop": [d.isoformat() for d in gone]}))
        folder.rename(DRAFT, INTENT)
    recover(spark, path)


def recover(spark: SparkSession, path: str) -> bool:
    """Finish a publication that has its intent, else remove what one without it left; says whether there was an intent."""
    folder = Folder(spark, path)
    found = folder.exists(INTENT)
    if found:
        intent = json.loads(folder.read(INTENT))
        for day in intent["swap"]:
            _swap(folder, f"day={day}")
        for day in intent["drop"]:
            folder.delete(f"day={day}")
    for name in (STAGING, DRAFT, INTENT):  # the intent last: until then everything can be done again
        if folder.exists(name):
            folder.delete(name)
    return found


def _swap(folder: Folder, day: str) -> None:
    """A day that is no longer staged is in its place already."""
    if folder.exists(f"{STAGING}/{day}"):
        folder.delete(day)
        folder.rename(f"{STAGING}/{day}", day)
