"""Small keyed tables with versions: rules, presets, watchlists, an audit trail.

A version is a folder of Parquet files and a file that names it. That file is put in its place by a rename, which fails
if another writer was first; then the change is made again on that writer's version. Readers take the newest one that is
named, so they see a whole version, whatever is written meanwhile.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Other writers were first too often."""


class Table:
    """A table below ``folder``, which all writers and readers share, with a unique ``key``."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: list[str]):
        self.spark, self.folder, self.schema, self.key = spark, folder.rstrip("/"), schema, key
        self.files = self._path("versions").getFileSystem(spark._jsc.hadoopConfiguration())
        self.files.mkdirs(self._path("versions"))

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *names]))

    def version(self) -> int:
        """The newest version; 0 before the first."""
        names = [f.getPath().getName() for f in self.files.listStatus(self._path("versions"))]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest, or of an earlier, version; none before the first."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], self.schema)
        named = json.loads(self.spark.read.text(f"{self.folder}/versions/{version:09}.json").first()[0])
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{named['rows']}")

    def _named(self, version: int, rows: str) -> bool:
        """Whether ``rows`` became ``version``; no, if another writer named one so before."""
        waiting, name = self._path("waiting", uuid.uuid4().hex), self._path("versions", f"{version:09}.json")
        out = self.files.create(waiting, True)
        out.write(json.dumps({"rows": rows}).encode())
        out.close()
        options = self.spark._jvm.org.apache.hadoop.fs.Options
        none = self.spark.sparkContext._gateway.new_array(options.Rename, 1)
        none[0] = options.Rename.NONE  # does not replace what is there
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(waiting.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(context.makeQualified(waiting), context.makeQualified(name), none)
        except Exception as failure:
            if "FileAlreadyExists" not in str(failure):
                raise
            self.files.delete(waiting, False)
            return False
        return True

    def change(self, made: Callable[[DataFrame], DataFrame], tries: int = 20) -> int:
        """Make ``made(rows of the newest version)`` the next version, whose number is returned."""
        for _ in range(tries):
            before = self.version()
            rows = f"rows-{uuid.uuid4().hex}"
            made(self.read(before)).select(*self.read(0).columns).write.parquet(f"{self.folder}/{rows}")
            if self._named(before + 1, rows):
                return before + 1
            self.files.delete(self._path(rows), True)
        raise Conflict(f"{self.folder}: {tries} versions of others came first")

    def put(self, rows: DataFrame) -> int:
        """Add ``rows``, in place of those with their keys; of rows with one key any stays. A null is a key like others."""
        rows = rows.select(*self.read(0).columns).dropDuplicates(self.key)
        return self.change(lambda now: self._without(now, rows).unionByName(rows))

    def remove(self, keys: DataFrame) -> int:
        """Drop the rows with ``keys``; keys that no row has change nothing."""
        return self.change(lambda now: self._without(now, keys))

    def _without(self, now: DataFrame, keys: DataFrame) -> DataFrame:
        gone = keys.select(*(F.col(k).alias(f"_{k}") for k in self.key)).distinct()
        same = F.lit(True)
        for k in self.key:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        return now.join(gone, same, "left_anti")


WATCHLIST = "name string, symbol string"
PRESET = "name string, kind string, parameters string"
AUDIT = "at timestamp, entry string, actor string, action string, detail string"


def watchlists(spark: SparkSession, folder: str) -> Table:
    return Table(spark, f"{folder}/watchlists", WATCHLIST, ["name", "symbol"])


def presets(spark: SparkSession, folder: str) -> Table:
    """Named sets of parameters of a strategy or a scan, as JSON."""
    return Table(spark, f"{folder}/presets", PRESET, ["name", "kind"])


def alert_rules(spark: SparkSession, folder: str) -> Table:
    from tapeworks.operators.alerts import RULE

    return Table(spark, f"{folder}/rules", f"{RULE}, enabled boolean", ["rule_id"])


def audit(spark: SparkSession, folder: str) -> Table:
    return Table(spark, f"{folder}/audit", AUDIT, ["entry"])


def record(trail: Table, actor: str, action: str, detail: str | None = None) -> int:
    """One line of an audit trail, with the time at which it was written."""
    line = trail.spark.createDataFrame([(uuid.uuid4().hex, actor, action, detail)], "entry string, actor string, action string, detail string")
    return trail.put(line.withColumn("at", F.current_timestamp()))


def watched(bars: DataFrame, lists: Table, name: str | None = None, symbols: tuple[str, ...] = ()) -> DataFrame:
    """``bars`` of the symbols of a watchlist and of ``symbols``, whatever their case; of all if neither is given. An unknown list is an error."""
    if name is None and not symbols:
        return bars
    wanted = bars.sparkSession.createDataFrame([(s,) for s in symbols], "symbol string")
    if name is not None:
        listed = lists.read().where(F.col("name") == name).select("symbol")
        if listed.isEmpty():
            raise LookupError(f"no watchlist {name}")
        wanted = wanted.unionByName(listed)
    keys = wanted.select(F.upper("symbol").alias("_symbol")).distinct()
    return bars.join(keys, F.upper("symbol") == F.col("_symbol"), "left_semi")
