"""Index tables in a folder: cut into buckets by a key, changed bucket by bucket, committed together.

A commit writes the changed buckets of any number of tables and then one manifest that names the folders of all. What has
no manifest does not count, so a job that is lost midway changes nothing, and no table is ever ahead of another. Of two
writers that begin from the same version one fails. Any file system that Spark reads will do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dowser.session import Folder

BUCKETS, KEPT, MERGE = 16, 3, 8


def bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(buckets)).cast("int")


class ConcurrentChangeError(RuntimeError):
    """Another writer committed in between; the change has no effect."""


@dataclass
class Change:
    """What a commit does to a table: appends rows, or puts rows in place of all rows of some buckets (None: of all)."""

    rows: DataFrame
    append: bool = False
    buckets: set[int] | None = None


class Store:
    def __init__(self, spark: SparkSession, root: str, tables: Mapping[str, tuple[T.StructType, str]], buckets: int = BUCKETS):
        """tables: by name the schema and the key by which rows are cut into buckets. `buckets` holds for a new folder;
        each should hold as much as one is ready to rewrite for a change of a few rows."""
        self.spark, self.folder, self.tables = spark, Folder(spark, root), dict(tables)
        self.version, state = self._latest()
        self.buckets = state.get("buckets", buckets)
        self.where: dict[str, dict[int, list[str]]] = {t: {int(b): f for b, f in w.items()} for t, w in state.get("where", {}).items()}
        self.notes: dict[str, str] = state.get("notes", {})

    def _manifests(self) -> list[int]:
        return sorted(int(n[9:-5]) for n in self.folder.names() if n.startswith("manifest-") and n.endswith(".json"))

    def _latest(self) -> tuple[int, dict]:
        done = self._manifests()
        return (done[-1], json.loads(self.folder.read(f"manifest-{done[-1]}.json"))) if done else (0, {})

    def refresh(self) -> None:
        """Takes up what other writers committed."""
        self.version, state = self._latest()
        self.where = {t: {int(b): f for b, f in w.items()} for t, w in state.get("where", {}).items()}
        self.notes = state.get("notes", {})

    def read(self, name: str, buckets: set[int] | None = None) -> DataFrame:
        schema, _ = self.tables[name]
        folders = [f"{self.folder.path}/{f}/bucket={b}" for b, fs in self.where.get(name, {}).items() if buckets is None or b in buckets for f in fs]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def touched(self, keys: DataFrame, key: str) -> set[int]:
        """The buckets of some keys: at most as many numbers as there are buckets."""
        return {r.b for r in keys.select(bucket(key, self.buckets).alias("b")).distinct().collect()}

    def commit(self, changes: Mapping[str, Change], notes: Mapping[str, str] | None = None) -> None:
        """All the changes, or none of them. notes: small texts kept beside the tables."""
        number, stamp = self.version + 1, uuid.uuid4().hex[:8]
        where = {t: {b: list(f) for b, f in w.items()} for t, w in self.where.items()}
        for name, change in changes.items():
            schema, key = self.tables[name]
            own = where.setdefault(name, {})
            rows = change.rows
            columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
            path = f"{name}/v{number}-{stamp}"
            out = rows.select(*columns).withColumn("bucket", bucket(key, self.buckets))
            out.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder.path}/{path}")
            written = {int(n.partition("=")[2]) for n in self.folder.at(path).names() if n.startswith("bucket=")}
            if not change.append:
                for b in list(own) if change.buckets is None else change.buckets:
                    own.pop(b, None)
            for b in written:
                own[b] = [*own.get(b, []), path]
        state = {"buckets": self.buckets, "where": where, "notes": self.notes | dict(notes or {})}
        if not self.folder.write(f"manifest-{number}.json", json.dumps(state), replace=False):
            raise ConcurrentChangeError(f"version {number} of {self.folder.path} is there already")
        self.version, self.where, self.notes = number, where, state["notes"]
        self._clean()

    def merge(self, name: str) -> None:
        """Puts together the buckets of a table whose rows lie in many folders."""
        many = {b for b, f in self.where.get(name, {}).items() if len(f) > MERGE}
        if many:
            self.commit({name: Change(self.read(name, many), buckets=many)})

    def _clean(self) -> None:
        """Removes the folders that only versions before the last KEPT name."""
        done = self._manifests()
        old, kept = done[:-KEPT], done[-KEPT:]
        if not old:
            return
        names = lambda ns: {f for n in ns for w in json.loads(self.folder.read(f"manifest-{n}.json"))["where"].values() for fs in w.values() for f in fs}
        for path in names(old) - names(kept):
            self.folder.delete(path)
        for n in old:
            self.folder.delete(f"manifest-{n}.json")
