"""Publishing partitions of a stored table: staged beside it, then swapped in by a journal that can be finished later.

A swap has three states that a reader can tell apart. Without a journal the table is what it was, and staged folders are
left-overs. The journal lists the partitions to put in place and those to take away; it comes into being whole, by a
rename, when all staged files are there. From then on the swap counts as done: who reads or writes the table next
finishes what is left of it, in any order and as often as need be. One writer at a time; only folders are
renamed, so the driver handles one name per partition and no data.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

STAGED, JOURNAL = ".staged-", "_swap.json"  # names that Spark's readers pass over


class Folder:
    """A folder of a store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path, self.gateway = spark._jvm, path, spark.sparkContext._gateway
        self.fs = self._at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, inside: str = "") -> list[str]:
        place = self._at(f"{self.path}/{inside}" if inside else self.path)
        return [s.getPath().getName() for s in self.fs.listStatus(place)] if self.fs.exists(place) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._at(f"{self.path}/{name}"))

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(f"{self.path}/{name}"), True)

    def move(self, name: str, to: str) -> None:
        if not self.fs.rename(self._at(f"{self.path}/{name}"), self._at(f"{self.path}/{to}")):
            raise OSError(f"cannot move {self.path}/{name}")

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(f"{self.path}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """A file that is there whole or not at all."""
        self.move(self._part(text), name)

    def write_new(self, name: str, text: str) -> bool:
        """The same, unless there is such a file already; then it stays and the answer is no."""
        part = self._part(text)
        names = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.fs.getConf())
        options = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            names.rename(self._at(f"{self.path}/{part}"), self._at(f"{self.path}/{name}"), options)
        except Py4JJavaError:
            self.delete(part)
            if self.exists(name):
                return False
            raise
        return True

    def _part(self, text: str) -> str:
        part = f"{STAGED}{uuid.uuid4().hex}.json"
        stream = self.fs.create(self._at(f"{self.path}/{part}"), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return part


def finish(spark: SparkSession, path: str) -> None:
    """Finish a swap that was cut short; nothing to do without a journal."""
    folder = Folder(spark, path)
    if folder.exists(JOURNAL):
        _carry_out(folder, json.loads(folder.read(JOURNAL)))


def _carry_out(folder: Folder, journal: dict) -> None:
    staged = journal["staged"]
    for name in journal["put"]:
        if folder.exists(f"{staged}/{name}"):  # else it is in place already
            folder.delete(name)
            folder.move(f"{staged}/{name}", name)
    for name in journal["drop"]:
        folder.delete(name)
    folder.delete(staged)
    folder.delete(JOURNAL)


def stage(spark: SparkSession, path: str) -> str:
    """The name of a new folder to write to; what earlier writers left unfinished is finished or cleared first."""
    finish(spark, path)
    folder = Folder(spark, path)
    for name in folder.names():
        if name.startswith(STAGED):
            folder.delete(name)
    return f"{STAGED}{uuid.uuid4().hex}"


def publish(spark: SparkSession, path: str, staged: str, emptied: list[str]) -> None:
    """Put the staged partitions in the place of those of their names, and take away ``emptied`` ones that got no rows."""
    folder = Folder(spark, path)
    put = sorted(n for n in folder.names(staged) if "=" in n)
    journal = {"staged": staged, "put": put, "drop": sorted(set(emptied) - set(put))}
    folder.write(JOURNAL, json.dumps(journal))
    _carry_out(folder, journal)
