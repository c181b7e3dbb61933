"""A stored table that grows by deltas: writes cost what they bring, reads merge, compaction is tiered.

Layout below `path`: `data/of=<folder>` holds rows, `commits/version=<n>` one JSON row that lists the live
folders in order. A write stages a new folder and then adds one commit, a single file that Spark's commit
moves into place: a reader sees the table before or after it and never between, and a write that broke off
leaves a folder that nothing names. There is one writer per table; two that meet in one version are noticed.

Rows carry their rank (version, seq, hash): the newest row of a key wins and a sticky column keeps its
newest value that isn't NULL. Both are associative over neighbouring folders, so folders merge in any
grouping. `fanout` folders of a level become one of the next: a row is rewritten once a level, and the
folders a reader merges are at most `fanout` a level.

Cases: a null key is a key like others; repeated rows of a batch are one; an empty batch writes nothing;
columns that the schema doesn't have are left out, missing ones are NULL.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FANOUT = 8
_RANK = "_v bigint, _s bigint, _h bigint"
_COMMIT = (
    "folders array<struct<name:string,level:int,until:bigint>>, batches map<string,bigint>, "
    "sticky array<string>"
)


@dataclass(frozen=True)
class Commit:
    """Live folders (name, level, last version in it), oldest first; the last batch id of every stream."""

    version: int
    folders: list
    batches: dict


@dataclass(frozen=True)
class DeltaTable:
    """`keys` name a row; `partition`, one of them, lays out compacted folders; `sticky` columns outlive NULL.

    Where the newest row of a key meets the condition `gone`, the key isn't there: readers don't see it, and
    it is dropped when the oldest folder is merged, below which no older row can wait.
    """

    spark: SparkSession
    path: str
    schema: str
    keys: tuple[str, ...]
    partition: str | None = None
    sticky: tuple[str, ...] = ()
    gone: str = "false"

    def __post_init__(self):
        unknown = {*self.keys, *self.sticky, *filter(None, [self.partition])} - set(self._columns())
        if unknown or (self.partition and self.partition not in self.keys):
            raise ValueError(f"not columns, or a partition that isn't a key: {sorted(unknown) or self.partition}")

    def _columns(self) -> list[str]:
        return StructType.fromDDL(self.schema).fieldNames()

    def _folder(self, name: str) -> str:
        return f"{self.path}/data/of={name}"

    # --- commits --------------------------------------------------------------------------------
    def newest(self) -> Commit:
        """The newest commit; version 0 where there is none."""
        try:
            log = self.spark.read.schema(f"{_COMMIT}, version bigint").json(f"{self.path}/commits")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return Commit(0, [], {})
        rows = log.groupBy("version").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("folders", "batches", "sticky")).alias("c"))
        found = rows.orderBy(F.desc("version")).limit(1).collect()
        if not found:
            return Commit(0, [], {})
        version, n, c = found[0]
        if n > 1:
            raise RuntimeError(f"two writers met in version {version} of {self.path}")
        if list(c.sticky) != list(self.sticky):
            raise ValueError(f"{self.path} has the sticky columns {c.sticky}, not {list(self.sticky)}")
        return Commit(version, list(c.folders), dict(c.batches))

    def _commit(self, version: int, folders: list, batches: dict) -> None:
        row = self.spark.createDataFrame([(folders, batches, list(self.sticky))], _COMMIT)
        row.coalesce(1).write.mode("errorifexists").json(f"{self.path}/commits/version={version}")

    # --- writing --------------------------------------------------------------------------------
    def append(self, updates: DataFrame, seq: str | None = None, stream: str = "", batch: int | None = None) -> bool:
        """Adds `updates` without a shuffle and without reading the table; True where a commit was made.

        Among rows of a key the highest `seq` wins, then a hash of the values. A `batch` that `stream` has
        already brought is passed over, so a stream that repeats its last batch adds nothing.
        """
        now = self.newest()
        if batch is not None and batch <= now.batches.get(stream, -1):
            return False
        have = set(updates.columns)
        fields = StructType.fromDDL(self.schema).fields
        columns = [
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields
        ]
        order = F.col(seq).cast("bigint") if seq else F.lit(0).cast("bigint")
        version = now.version + 1
        rows = updates.select(*columns, order.alias("_s")).select(
            *self._columns(), F.lit(version).cast("bigint").alias("_v"), "_s",
            F.xxhash64(F.to_json(F.struct(*self._columns()))).alias("_h"),
        )
        name = self._write(rows, version, 0)
        batches = now.batches | ({stream: batch} if batch is not None else {})
        self._commit(version, [*now.folders, (name, 0, version)] if name else now.folders, batches)
        return True

    def _write(self, rows: DataFrame, version: int, level: int) -> str | None:
        """A new folder with `rows`; None where there are no rows."""
        name = f"{version}-{level}-{uuid.uuid4().hex}"
        if level and self.partition:
            # rebalance: small runs share a task and a hot run is split, each at a sane file size
            rows = rows.hint("rebalance", F.col(self.partition))
        out = rows.write
        if level and self.partition:
            out = out.partitionBy(self.partition)
        out.parquet(self._folder(name))
        if not level and self._read([(name, 0, version)]).isEmpty():
            return None
        return name

    # --- reading --------------------------------------------------------------------------------
    def _read(self, folders: list) -> DataFrame:
        """The rows of some folders with their ranks. Only compacted folders are laid out by the partition."""
        full = f"{self.schema}, {_RANK}"
        groups = [[f for f in folders if f[1] == 0], [f for f in folders if f[1] > 0]]
        parts = [
            self.spark.read.schema(full).option("basePath", f"{self.path}/data")
            .parquet(*[self._folder(f[0]) for f in group]).select(*self._columns(), "_v", "_s", "_h")
            for group in groups if group
        ]
        if not parts:
            return self.spark.createDataFrame([], full)
        return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]

    def _merged(self, rows: DataFrame) -> DataFrame:
        """One row per key, combined before the one shuffle; a filter on keys reaches the scan."""
        plain = [c for c in self._columns() if c not in self.keys and c not in self.sticky]
        rank = F.struct("_v", "_s", "_h")
        aggs = [F.max_by(F.struct(F.lit(0).alias("_"), *plain), rank).alias("_row")]
        aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in self.sticky]
        best = rows.groupBy(*self.keys).agg(*aggs)
        return best.select(*[F.col(f"_row.{c}").alias(c) if c in plain else F.col(c) for c in self._columns()])

    def read(self) -> DataFrame:
        """The table as of the newest commit."""
        return self._there(self._merged(self._read(self.newest().folders)))

    def _there(self, merged: DataFrame) -> DataFrame:
        return merged.where(~F.coalesce(F.expr(self.gone), F.lit(False))) if self.gone != "false" else merged

    # --- upkeep ---------------------------------------------------------------------------------
    def compact(self, fanout: int = FANOUT) -> int:
        """Merges every level that has `fanout` folders into one of the next; the number of merges."""
        if fanout < 2:
            raise ValueError("fanout has to be 2 or more")
        done = 0
        while True:
            now = self.newest()
            levels = {}
            for f in now.folders:
                levels.setdefault(f[1], []).append(f)
            full = [level for level in sorted(levels) if len(levels[level]) >= fanout]
            if not full:
                return done
            level, own = full[0], levels[full[0]]
            until = own[-1][2]
            # levels fall from old to new, so the folders of one are neighbours
            kept = [tuple(f) for f in now.folders if f not in own]
            at = sum(f[1] > level for f in kept)
            merged = self._merged(self._read(own))
            merged = (merged if at else self._there(merged)).select(
                "*", F.lit(until).cast("bigint").alias("_v"), F.lit(0).cast("bigint").alias("_s"), F.lit(0).cast("bigint").alias("_h")
            )
            name = self._write(merged, until, level + 1)
            self._commit(now.version + 1, [*kept[:at], (name, level + 1, until), *kept[at:]], now.batches)
            done += 1

    def vacuum(self, commits: int = 100) -> int:
        """Deletes all but the newest `commits` commits and the folders that none of those names.

        Readers of older versions and a write under way must have ended.
        """
        now = self.newest()
        log = self.spark.read.schema(f"{_COMMIT}, version bigint").json(f"{self.path}/commits")
        kept = log.where(F.col("version") > now.version - max(commits, 1))
        live = {r[0] for r in kept.select(F.explode("folders.name")).distinct().collect()}
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        files = path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone = 0
        for kind in ("data", "commits"):
            if not files.exists(path(f"{self.path}/{kind}")):
                continue
            for status in files.listStatus(path(f"{self.path}/{kind}")):
                name = status.getPath().getName()
                old = name.startswith("version=") and int(name[8:]) <= now.version - max(commits, 1)
                if old or (kind == "data" and name.removeprefix("of=") not in live):
                    files.delete(status.getPath(), True)
                    gone += 1
        return gone
