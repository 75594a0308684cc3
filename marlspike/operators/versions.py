"""Tables that survive: parts in a folder, and a numbered list of parts for each version.

A change writes its rows as new parquet parts and then publishes the next version by moving that
version's list into place, which fails if another writer's is there already; a crash before that
leaves the version before as it was. Rows are merged when read: a part has the number of the version that brought
it, and a deletion (a part of ids) removes rows of parts with smaller numbers. ``compact`` writes the
current rows as one part; older versions can be read until ``vacuum`` removes what only they list.

The folder may be on any Hadoop file system that moves a file without overwriting atomically.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from marlspike.operators.store import StoreError


class Conflict(StoreError):
    """Another writer has published the version that this one was about to."""


@dataclass(frozen=True)
class Version:
    """``rows`` and ``gone`` list parts as (number of the version that brought it, folder)."""

    number: int
    schema: str
    rows: tuple[tuple[int, str], ...] = ()
    gone: tuple[tuple[int, str], ...] = ()


class VersionedTable:
    """A table with a key column, at the newest version or an older one. Changes return the table at the new version."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", number: int | None = None):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        numbers = self.numbers()
        if not numbers:
            raise StoreError(f"no table at {self.path}")
        if number is not None and number not in numbers:
            raise StoreError(f"version {number} is unknown or was removed")
        self.version = self._read(max(numbers) if number is None else number)

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: str, key: str = "id") -> VersionedTable:
        """An empty table; one that is there already is an error."""
        table = cls.__new__(cls)
        table.spark, table.path, table.key = spark, path.rstrip("/"), key
        table._fs = spark._jvm.org.apache.hadoop.fs.Path(table.path).getFileSystem(spark._jsc.hadoopConfiguration())
        table._publish(Version(0, schema))
        return cls(spark, path, key)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def numbers(self) -> list[int]:
        folder = self._path("versions")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _read(self, number: int) -> Version:
        row = self.spark.read.text(f"{self.path}/versions/{number:012d}.json", wholetext=True).first()
        held = json.loads(row[0])
        return Version(held["number"], held["schema"], tuple(map(tuple, held["rows"])), tuple(map(tuple, held["gone"])))

    def _publish(self, version: Version) -> None:
        """Creates the version's list. It is written aside first, so that a list is whole or not there."""
        target, aside = self._path(f"versions/{version.number:012d}.json"), self._path(f"versions/.{uuid.uuid4().hex}")
        held = {"number": version.number, "schema": version.schema, "rows": version.rows, "gone": version.gone}
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(held).encode()))
        out.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        never_over = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        never_over[0] = hadoop.Options.Rename.NONE
        try:
            hadoop.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, target, never_over)
        except Py4JJavaError as e:
            self._fs.delete(aside, False)
            if not self._fs.exists(target):
                raise
            raise Conflict(f"version {version.number} was published by another writer") from e

    def _part(self, rows: DataFrame) -> str:
        name = f"parts/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def _next(self, rows: DataFrame | None = None, gone: DataFrame | None = None) -> VersionedTable:
        v, number = self.version, self.version.number + 1
        if gone is not None:
            v = replace(v, gone=(*v.gone, (number, self._part(gone))))
        if rows is not None:
            v = replace(v, rows=(*v.rows, (number, self._part(self._shaped(rows)))))
        self._publish(replace(v, number=number))
        return VersionedTable(self.spark, self.path, self.key, number)

    def _shaped(self, rows: DataFrame) -> DataFrame:
        """The rows with the table's columns; those not given are null."""
        empty = self.spark.createDataFrame([], self.version.schema)
        if unknown := set(rows.columns) - set(empty.columns):
            raise StoreError(f"unknown columns: {sorted(unknown)}")
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema.fields])

    def rows(self) -> DataFrame:
        """The rows of this version: those of its parts that no later deletion names."""
        v = self.version
        empty = self.spark.createDataFrame([], v.schema)
        if not v.rows:
            return empty
        # parts that came with the same version, or between the same deletions, need no telling apart
        groups: dict[int, list[str]] = {}
        for number, part in v.rows:
            groups.setdefault(sum(1 for g, _ in v.gone if g <= number), []).append(f"{self.path}/{part}")
        out = []
        for later, paths in sorted(groups.items()):
            rows = self.spark.read.schema(empty.schema).parquet(*paths)
            deletions = [f"{self.path}/{part}" for _, part in v.gone[later:]]
            if deletions:
                rows = rows.join(self.spark.read.parquet(*deletions).select(self.key).distinct(), self.key, "left_anti").select(*empty.columns)
            out.append(rows)
        return reduce(DataFrame.unionByName, out)

    def _checked(self, keys: DataFrame) -> DataFrame:
        if not keys.where(F.col(self.key).isNull()).isEmpty():
            raise StoreError("a key is null")
        if not keys.groupBy(self.key).count().where("count > 1").isEmpty():
            raise StoreError("a key is given twice")
        return keys

    def add(self, new: DataFrame) -> VersionedTable:
        """Rows with new keys; known, null and repeated keys are refused."""
        self._checked(new.select(self.key))
        if not new.select(self.key).join(self.rows().select(self.key), self.key, "left_semi").isEmpty():
            raise StoreError("a key is known already")
        return self._next(rows=new)

    def upsert(self, new: DataFrame) -> tuple[VersionedTable, int]:
        """Rows in place of those with their keys, or new; how many were replaced. Columns that aren't given keep a replaced row's value."""
        self._checked(new.select(self.key))
        old = self.rows()
        kept = [c for c in old.columns if c not in new.columns]
        known = old.join(new.select(self.key), self.key, "left_semi")
        whole = self._shaped(new) if not kept else self._shaped(new.join(known.select(self.key, *kept), self.key, "left"))
        n = known.count()
        return self._next(rows=whole, gone=new.select(self.key)), n

    def delete(self, keys: DataFrame) -> tuple[VersionedTable, int]:
        """Without the rows of these keys; how many went. Unknown keys are passed over."""
        keys = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        n = self.rows().join(keys, self.key, "left_semi").count()
        return (self._next(gone=keys), n) if n else (self, 0)

    def compact(self) -> VersionedTable:
        """The same rows as one part. A writer that publishes meanwhile makes this a conflict, never the other way round lost."""
        number = self.version.number + 1
        part = self._part(self.rows())
        self._publish(Version(number, self.version.schema, ((number, part),)))
        return VersionedTable(self.spark, self.path, self.key, number)

    def vacuum(self, keep: int = 1) -> int:
        """Removes all but the newest ``keep`` versions and parts that none of these lists; how many parts went.

        Not to be run while a writer is at work, whose parts no list names yet.
        """
        numbers = self.numbers()
        stay = [self._read(n) for n in numbers[-max(1, keep) :]]
        for n in numbers[: -max(1, keep)]:
            self._fs.delete(self._path(f"versions/{n:012d}.json"), False)
        named = {part.split("/")[1] for v in stay for _, part in (*v.rows, *v.gone)}
        folder = self._path("parts")
        parts = [f.getPath() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        gone = [p for p in parts if p.getName() not in named]
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)


def current(spark: SparkSession, path: str, key: str = "id", tries: int = 5):
    """Runs a change on the newest version and, where another writer came first, again: ``current(...)(lambda t: t.upsert(rows))``."""

    def run(change):
        for left in range(tries - 1, -1, -1):
            try:
                return change(VersionedTable(spark, path, key))
            except Conflict:
                if not left:
                    raise

    return run
