"""Tables that change all at once: every change writes new folders and is published by one rename.

Rows lie in cells by day and key hash. A version lists the folder of every cell
of every table; a change reads and writes only the cells that it touches, lists
them in the next version, and publishes that last. Until then readers see the
version before, and what a failed change has written is never listed. For each
table a second one keeps the day of every key, so that a change finds its cells
by the key's hash and not by looking through the table. A table may also have a
rollup: small sums per cell, made anew for the cells of a change and published
with them, so that they always agree with the rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.operators.tables import DAY, newest, table_exists, upsert
from logloom.session import staged

BUCKETS = 16
_KEYS, _ROLLUP, _NONE = "_keys", "_rollup", "none"
_CELL = r"/_p_day=([^/]*)/_p_cell=(\d+)/[^/]*$"
#: A cell: its day (or none) and its bucket.
Cell = tuple[str, int]


class Conflict(RuntimeError):
    """Another change was published meanwhile; take it again."""


@dataclass(frozen=True)
class Version:
    """What is published: the folder of every cell, and the columns of every table."""

    number: int = 0
    schemas: dict[str, str] = field(default_factory=dict)
    cells: dict[str, dict[Cell, str]] = field(default_factory=dict)

    def text(self) -> str:
        cells = {t: [[*cell, path] for cell, path in sorted(found.items())] for t, found in self.cells.items()}
        return json.dumps({"number": self.number, "schemas": self.schemas, "cells": cells})

    @staticmethod
    def of(text: str) -> Version:
        said = json.loads(text)
        cells = {t: {(day, bucket): path for day, bucket, path in found} for t, found in said["cells"].items()}
        return Version(said["number"], said["schemas"], cells)


class Store:
    """Tables under ``root`` that are changed together. ``step`` is called after each step of a change.

    ``rollups`` names for some tables the function that sums their rows up by day
    and the columns ``_p_day`` and ``_p_cell``, which it keeps. A change made
    without it leaves the cells it touches without sums until ``refresh``.
    """

    def __init__(
        self, spark: SparkSession, root: str, key: str = "id", buckets: int = BUCKETS, step: Callable[[str], None] | None = None,
        rollups: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
    ):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self.rollups = rollups or {}
        self.step = step or (lambda name: None)

    # --- Versions

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def versions(self) -> list[int]:
        """The numbers of the versions that are published, oldest first."""
        if not table_exists(self.spark, f"{self.root}/versions"):
            return []
        top = self._path("versions")
        found = top.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(top)
        return sorted(int(s.getPath().getName()) for s in found if s.getPath().getName().isdigit())

    def version(self, number: int | None = None) -> Version:
        numbers = self.versions()
        if number is None:
            number = numbers[-1] if numbers else 0
        if number == 0:
            return Version()
        return Version.of(self.spark.read.text(f"{self.root}/versions/{number:010d}", wholetext=True).first()[0])

    def _publish(self, new: Version) -> None:
        name = f"_next-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(new.text(),)], "value string").coalesce(1).write.text(f"{self.root}/{name}")
        self.step("listed")
        jvm, top = self.spark._jvm, self._path("versions")
        top.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(top)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(top.toUri(), self.spark._jsc.hadoopConfiguration())
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        try:  # fails if the version exists, in one step
            context.rename(self._path(name), self._path(f"versions/{new.number:010d}"), how)
        except Exception as failed:
            if new.number in self.versions():
                raise Conflict(f"version {new.number} was published by another change") from failed
            raise
        self.step("published")

    # --- Reading

    def read(self, table: str, version: Version | None = None, cells: set[Cell] | None = None) -> DataFrame | None:
        """A table of a version, by default the newest; ``cells`` reads only these. None if there is none."""
        now = version or self.version()
        if table not in now.schemas:
            return None
        kind = T.StructType.fromJson(json.loads(now.schemas[table]))
        found = now.cells.get(table, {})
        paths = sorted(path for cell, path in found.items() if cells is None or cell in cells)
        if not paths:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.root}/{path}" for path in paths])

    def _cells_of(self, table: str, keys: DataFrame, now: Version) -> set[Cell]:
        """The cells that hold any of the keys; reads only the key buckets that these fall into."""
        marked = staged(keys.select(self.key, self._bucket().alias("_bucket")).distinct())
        buckets = {r[0] for r in marked.select("_bucket").distinct().collect()}
        known = self.read(table + _KEYS, now, {(_NONE, b) for b in buckets})
        if known is None:
            return set()
        return {(r._day, r._bucket) for r in known.join(marked, self.key).select("_day", "_bucket").distinct().collect()}

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    @staticmethod
    def _day() -> Column:
        return F.coalesce(F.col(DAY).cast("string"), F.lit(_NONE))

    # --- Changing

    def _write(self, table: str, placed: DataFrame) -> dict[Cell, str]:
        """Store rows by cell in a folder of their own. Large cells are split over files, small ones are not."""
        folder = f"data/{uuid.uuid4().hex}-{table}"
        placed.hint("rebalance", "_p_day", "_p_cell").write.partitionBy("_p_day", "_p_cell").parquet(f"{self.root}/{folder}")
        names = [(day, cell) for day in self._folders(folder) for cell in self._folders(f"{folder}/{day}")]
        self.step(f"written {table}")
        return {(day.split("=", 1)[1], int(cell.split("=", 1)[1])): f"{folder}/{day}/{cell}" for day, cell in names}

    def _folders(self, folder: str) -> list[str]:
        top = self._path(folder)
        found = top.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(top)
        return [s.getPath().getName() for s in found if s.isDirectory()]

    def _changed(self, now: Version, changes: dict[str, tuple[DataFrame | None, Column, set[Cell]]]) -> Version:
        """The version after replacing the given cells of tables by rows. The keys of a new table (None) are read from its rows."""
        schemas, cells = dict(now.schemas), {t: dict(found) for t, found in now.cells.items()}
        for table, (rows, day, old) in changes.items():
            if rows is None:
                own = table.removesuffix(_KEYS)
                rows = self.read(own, Version(0, schemas, cells)).select(self.key, self._day().alias("_day"))
            made = self._write(table, rows.withColumn("_p_day", day).withColumn("_p_cell", self._bucket()))
            kept = {cell: path for cell, path in cells.get(table, {}).items() if cell not in old}
            cells[table] = kept | made
            schemas[table] = rows.schema.json()
            rolled = table + _ROLLUP
            if rolled in schemas or table in self.rollups:
                cells[rolled] = {c: path for c, path in cells.get(rolled, {}).items() if c in kept and c not in made}
            if table in self.rollups:
                schemas[rolled], sums = self._summed(table, rows.schema, made)
                cells[rolled] |= sums
        return Version(now.number + 1, schemas, cells)

    # --- Rollups

    def _summed(self, table: str, kind: T.StructType, cells: dict[Cell, str]) -> tuple[str, dict[Cell, str]]:
        """Sums of stored cells: their columns, and where they are stored."""
        if cells:
            rows = self.spark.read.schema(kind).parquet(*[f"{self.root}/{path}" for path in sorted(cells.values())])
            day, cell = (F.regexp_extract("_metadata.file_path", _CELL, i) for i in (1, 2))
        else:
            rows, day, cell = self.spark.createDataFrame([], kind), F.lit(_NONE), F.lit("0")
        sums = self.rollups[table](rows.withColumns({"_p_day": day, "_p_cell": cell.cast("int")}))
        made = self._write(table + _ROLLUP, sums) if cells else {}
        return sums.drop("_p_day", "_p_cell").schema.json(), made

    def _unsummed(self, table: str, now: Version) -> dict[Cell, str]:
        known = now.cells.get(table + _ROLLUP, {})
        return {cell: path for cell, path in now.cells.get(table, {}).items() if cell not in known}

    def refresh(self, table: str) -> int:
        """Sum up the cells that have no sums yet, as one change; returns how many they were."""
        now = self.version()
        lacking, rolled = self._unsummed(table, now), table + _ROLLUP
        if table not in now.schemas or (not lacking and rolled in now.schemas):
            return 0
        kind, made = self._summed(table, T.StructType.fromJson(json.loads(now.schemas[table])), lacking)
        cells = now.cells | {rolled: now.cells.get(rolled, {}) | made}
        self._publish(Version(now.number + 1, now.schemas | {rolled: kind}, cells))
        return len(lacking)

    def rollup(self, table: str, version: Version | None = None) -> DataFrame:
        """The sums of a table's cells; raises LookupError if any cell lacks them, for they would not agree with the rows."""
        now = version or self.version()
        if table + _ROLLUP not in now.schemas or self._unsummed(table, now):
            raise LookupError(f"{table} has cells without sums; call refresh")
        return self.read(table + _ROLLUP, now)

    def _known(self, known: DataFrame, fresh: DataFrame) -> tuple[set[Cell], set[Cell], set[int]]:
        """What stored keys tell of a change, from one join of the keys alone.

        The cells that hold any of the change's keys, the cells that hold other keys, and
        the buckets in which a key is new or gets another day.
        """
        came = fresh.groupBy(self.key).agg(F.min(self._day()).alias("_lo"), F.max(self._day()).alias("_hi"))
        both = known.join(came, self.key, "full").withColumn("_bucket", self._bucket())
        same = F.col("_day").eqNullSafe(F.col("_lo")) & F.col("_day").eqNullSafe(F.col("_hi"))
        found = both.groupBy("_day", "_bucket").agg(
            F.count_if(F.col("_lo").isNotNull()).alias("hit"), F.count_if(F.col("_lo").isNull()).alias("other"),
            F.count_if(F.col("_lo").isNotNull() & ~same).alias("differ")).collect()
        stored = [(r, (r._day, r._bucket)) for r in found if r._day is not None]
        return {c for r, c in stored if r.hit}, {c for r, c in stored if r.other}, {r._bucket for r in found if r.differ}

    def _replaced(self, table: str, rows: DataFrame | None, cells: set[Cell], keys: DataFrame | None, buckets: set[int]) -> dict:
        """The changes of a table and of its keys."""
        return {table: (rows, self._day(), cells), table + _KEYS: (keys, F.lit(_NONE), {(_NONE, b) for b in buckets})}

    def upsert(self, parts: dict[str, DataFrame], order: Column | None = None, moves: bool = True) -> int:
        """Insert or replace rows by key in several tables as one change; returns the version.

        Rows carry the day they are stored under (``dt``, which may be null). Of rows
        with one key that with the largest ``order`` counts; without it keys must
        differ. Taking a change again gives the same tables. With ``moves`` False the
        caller says that no stored key has another day. Keys are not null.
        """
        now, changes = self.version(), {}
        for table, incoming in parts.items():
            fresh = newest(incoming, self.key, order) if order is not None else incoming
            if table not in now.schemas:  # written as it comes, and its keys are read from there
                changes |= self._replaced(table, fresh, set(), None, set())
                continue
            fresh = staged(fresh)
            new = {(r[0], r[1]) for r in fresh.select(self._day(), self._bucket()).distinct().collect()}
            buckets = {b for _, b in new}  # a key that moves to another day stays in its bucket
            known = self.read(table + _KEYS, now, {(_NONE, b) for b in buckets})
            mixed, told = new, buckets
            if moves:
                held, mixed, told = self._known(known, fresh)
                new = new | held
            old = self.read(table, now, new & mixed)
            # a cell of which every row is replaced is not read
            rows = upsert(old, fresh, self.key) if new & mixed else old.unionByName(fresh, allowMissingColumns=True)
            changes[table] = (rows, self._day(), new)
            if told:  # else the keys stay as they are
                keys = fresh.select(self.key, self._day().alias("_day")).filter(self._bucket().isin(sorted(told)))
                changes |= {table + _KEYS: (upsert(self.read(table + _KEYS, now, {(_NONE, b) for b in told}), keys, self.key), F.lit(_NONE), {(_NONE, b) for b in told})}
        new = self._changed(now, changes)
        self._publish(new)
        return new.number

    def _without(self, now: Version, table: str, gone: DataFrame, cells: set[Cell]) -> dict:
        """The changes that take the rows of the keys ``gone`` out of cells of a table."""
        buckets = {b for _, b in cells}
        rows, known = self.read(table, now, cells), self.read(table + _KEYS, now, {(_NONE, b) for b in buckets})
        return self._replaced(table, rows.join(gone, self.key, "left_anti"), cells, known.join(gone, self.key, "left_anti"), buckets)

    def delete(self, table: str, ids: DataFrame) -> int:
        """Delete rows by key and return how many went; nothing is published if none did."""
        now, gone = self.version(), staged(ids.select(self.key).distinct())
        cells = self._cells_of(table, gone, now)
        if not cells:
            return 0
        count = self.read(table, now, cells).join(gone, self.key, "left_semi").count()
        self._publish(self._changed(now, self._without(now, table, gone, cells)))
        return count

    def cascade(self, ids: DataFrame, chain: tuple[tuple[str, str | None], ...]) -> dict[str, int]:
        """Delete rows and all that hangs on them, as one change; returns how many went by table.

        ``chain`` names the tables from the top down, each with the column that holds
        the key of its row in the table above. Rows below are stored under the day
        of the row that they hang on, so only these days are looked through.
        """
        now, changes, counts, days = self.version(), {}, {}, None
        gone = staged(ids.select(self.key).distinct())
        for table, parent in chain:
            if table not in now.schemas:
                counts[table] = 0
                continue
            if parent is None:
                cells = self._cells_of(table, gone, now)
                days = {day for day, _ in cells}
            else:
                cells = {cell for cell in now.cells[table] if days is None or cell[0] in days}
                above = gone.withColumnRenamed(self.key, parent)
                gone = staged(self.read(table, now, cells).join(above, parent, "left_semi").select(self.key).distinct())
                cells = self._cells_of(table, gone, now) & cells
            counts[table] = self.read(table, now, cells).join(gone, self.key, "left_semi").count() if cells else 0
            if cells:
                changes |= self._without(now, table, gone, cells)
        if changes:
            self._publish(self._changed(now, changes))
        return counts

    def clear(self) -> int:
        """Publish empty tables with the same columns; returns how many rows went."""
        now = self.version()
        count = sum(self.read(t, now).count() for t in now.schemas if not t.endswith((_KEYS, _ROLLUP)))
        if now.schemas:
            self._publish(Version(now.number + 1, now.schemas, {}))
        return count

    def vacuum(self, keep: int = 1) -> int:
        """Remove what only versions before the last ``keep`` list, and what failed changes left; returns how many folders went.

        Nobody may read those versions or make a change meanwhile.
        """
        numbers = self.versions()
        used = {path.split("/")[1] for n in numbers[-keep:] for found in self.version(n).cells.values() for path in found.values()}
        files = self._path("data").getFileSystem(self.spark._jsc.hadoopConfiguration())
        stale = [s.getPath() for s in files.listStatus(self._path("data")) if s.getPath().getName() not in used] if numbers else []
        stale += [self._path(f"versions/{n:010d}") for n in numbers[:-keep]]
        for path in stale:
            files.delete(path, True)
        return len(stale)
