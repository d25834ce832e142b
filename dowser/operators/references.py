"""References to records that do not exist, kept as incremental pending-orphan state.

The state is a folder with three keyed tables, each cut into buckets by the parent's key:

* parents(id, since, gone): a log of the times at which each parent came and was deleted;
* refs(src_table, row_id, file_id, at): every reference seen;
* pending(src_table, row_id, file_id, at, resolved_at): references whose parent was not there when they
  came, or was deleted afterwards. `resolved_at` is null while the reference still waits.

A parent is there from the first time it came after its last deletion, and absent for every reference, whatever its
time, if it did not come again. So the state depends on what was delivered and not on the order.

`advance` takes one batch of new references, parents and deletions. New references probe the parent index,
arriving parents resolve waiting orphans, deletions reopen them. A batch is appended to the first two tables, and only
the buckets that it touches are read, and written anew in the third where parents changed, so its cost goes with the batch
and the buckets it meets. No key is ever gathered in one task: references are reduced to one row a key before the parent index is
probed, the few keys with orphans are salted before they meet the references, and a bucket that holds a hot key is
written by many tasks. Every batch is a folder of its own, which counts once its manifest is there: a job that is lost
midway leaves the state as it was.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dowser.session import Folder, temporary_folder

SALTS, BUCKETS = 16, 8
#: A bucket whose rows lie in more batches than this is put together by the next batch that touches it.
MERGE = 8

REFS = "src_table string, row_id bigint, file_id bigint, at timestamp_ntz"
PARENTS = "id bigint, since timestamp_ntz, gone timestamp_ntz"
PENDING = REFS + ", resolved_at timestamp_ntz"
TABLES = {"refs": REFS, "parents": PARENTS, "pending": PENDING}
_ALWAYS = "0001-01-01"


def _time(at: str) -> Column:
    return F.coalesce(F.col(at).cast("timestamp_ntz"), F.lit(_ALWAYS).cast("timestamp_ntz"))


def references(df: DataFrame, src_table: str, key: str = "id", fk: str = "file_id", at: str = "create_time") -> DataFrame:
    """A table's references in the operator's form. Null references name nothing and are left out; a repeated
    row counts once; a null time counts as the beginning of time, so that any parent is later."""
    return df.where(F.col(fk).isNotNull() & F.col(key).isNotNull()).select(
        F.lit(src_table).alias("src_table"), F.col(key).cast("bigint").alias("row_id"), F.col(fk).cast("bigint").alias("file_id"), _time(at).alias("at"))


def parents(df: DataFrame, key: str = "id", at: str = "create_time") -> DataFrame:
    """Parents by key with the times they came at, each once. A null time counts as always there."""
    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), _time(at).alias("since"), F.lit(None).cast("timestamp_ntz").alias("gone")).distinct()


def deletions(df: DataFrame, key: str = "id", at: str = "ts") -> DataFrame:
    """Deletions of parents; those without a key or a time are left out, and of one parent's the latest counts."""
    return df.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(F.col(key).cast("bigint").alias("id")).agg(F.max(F.col(at).cast("timestamp_ntz")).alias("gone"))


def starts(log: DataFrame) -> DataFrame:
    """(id, start): from when each parent of the log is there; null if it is deleted."""
    gone = log.where(F.col("gone").isNotNull()).groupBy("id").agg(F.max("gone").alias("gone"))
    came = log.where(F.col("since").isNotNull()).select("id", "since").join(gone, "id", "left")
    there = came.select("id", F.when(F.col("gone").isNull() | (F.col("since") > F.col("gone")), F.col("since")).alias("start"))
    return there.unionByName(gone.select("id", F.lit(None).cast("timestamp_ntz").alias("start"))).groupBy("id").agg(F.min("start").alias("start"))


def probe(refs: DataFrame, begun: DataFrame) -> DataFrame:
    """The references whose parent is not there, or was not there at the time: pending rows. begun(id, start): from
    when each parent is there, null if it is deleted.

    `resolved_at` is the parent's time where it came later. Hot keys cost one row each in the probe, since the
    references are pre-aggregated by key; rows meet only the keys found to have orphans, salted by row.
    """
    keys = refs.groupBy("file_id").agg(F.min("at").alias("first_at"))
    bad = keys.join(begun.select(F.col("id").alias("file_id"), "start"), "file_id", "left").where(
        F.col("start").isNull() | (F.col("start") > F.col("first_at")))
    salted = bad.select("file_id", "start", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return (
        refs.withColumn("salt", F.pmod(F.col("row_id"), F.lit(SALTS)).cast("int"))
        .join(salted, ["file_id", "salt"])
        .where(F.col("start").isNull() | (F.col("start") > F.col("at")))
        .select("src_table", "row_id", "file_id", "at", F.col("start").alias("resolved_at"))
    )


@dataclass(frozen=True)
class OrphanState:
    """The state after some batches: for each table and bucket the folders that hold its rows. Frozen, so an older
    state stays readable."""

    spark: SparkSession
    folder: str
    buckets: int = BUCKETS
    version: int = 0
    where: dict[str, dict[int, list[str]]] = field(default_factory=lambda: {t: {} for t in TABLES})

    @staticmethod
    def empty(spark: SparkSession, folder: str | None = None, buckets: int = BUCKETS) -> OrphanState:
        """A new state in a folder that all executors share; by default one that goes when the program ends."""
        return OrphanState(spark, folder or temporary_folder(spark, "orphans"), buckets)

    @staticmethod
    def load(spark: SparkSession, folder: str) -> OrphanState:
        """The state after the last batch that was finished in a folder."""
        root = Folder(spark, folder)
        done = [int(n[1:]) for n in root.names() if n[:1] == "v" and root.at(n).exists("MANIFEST")]
        if not done:
            return OrphanState.empty(spark, folder)
        m = json.loads(root.at(f"v{max(done)}").read("MANIFEST"))
        return OrphanState(spark, folder, m["buckets"], max(done), {t: {int(b): f for b, f in w.items()} for t, w in m["where"].items()})

    def table(self, name: str, buckets: set[int] | None = None) -> DataFrame:
        """A table of the state, or some buckets of it."""
        folders = [f"{f}/bucket={b}" for b, fs in self.where[name].items() if buckets is None or b in buckets for f in fs]
        return self.spark.read.schema(TABLES[name]).parquet(*folders) if folders else self.spark.createDataFrame([], TABLES[name])

    @property
    def pending(self) -> DataFrame:
        return self.table("pending")

    @property
    def opened(self) -> DataFrame:
        """The references that the last batch brought and that had no parent then."""
        folder = f"{self.folder}/v{self.version}/opened"
        names = Folder(self.spark, folder).names()
        return self._part("pending", folder, {int(n.partition("=")[2]) for n in names if n.startswith("bucket=")})

    def _part(self, name: str, folder: str, buckets: set[int]) -> DataFrame:
        """Some buckets of one batch's folder."""
        return OrphanState(self.spark, self.folder, self.buckets, 0, {name: {b: [folder] for b in buckets}}).table(name)

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame, key: str, path: str) -> set[int]:
        """Writes rows by the bucket of their key; the buckets that have any."""
        df.withColumn("bucket", self._bucket(key)).hint("rebalance", "bucket").write.partitionBy("bucket").mode("overwrite").parquet(path)
        return {int(n.partition("=")[2]) for n in Folder(self.spark, path).names() if n.startswith("bucket=")}

    def advance(self, refs: DataFrame | None = None, new_parents: DataFrame | None = None, deleted: DataFrame | None = None) -> OrphanState:
        """The state after one more batch. refs: as from references(); new_parents: as from parents();
        deleted(id, gone): as from deletions().

        A parent delivered late, with a time before the reference, withdraws the orphan; one with a later time
        resolves it at that time. A reference delivered after its parent's deletion waits, whatever its time. A row
        delivered again changes nothing; copies of a row are taken to agree.
        """
        at, old = f"{self.folder}/v{self.version + 1}", self.where
        where = {t: {b: list(f) for b, f in w.items()} for t, w in old.items()}

        def keep(name: str, path: str, touched: set[int], alone: bool = False) -> None:
            for b in touched:
                where[name][b] = [path] if alone else [*where[name].get(b, []), path]

        log = self.spark.createDataFrame([], PARENTS)
        if new_parents is not None:
            log = log.unionByName(new_parents.select("id", "since", "gone"))
        if deleted is not None:
            log = log.unionByName(deleted.where(F.col("gone").isNotNull()).select("id", F.lit(None).cast("timestamp_ntz").alias("since"), "gone"))
        new = None
        if refs is not None:
            new = refs.select("src_table", "row_id", "file_id", "at").dropDuplicates(["src_table", "row_id"])
            if old["refs"]:  # rows that were seen before are left out; at most as many numbers as buckets go to the driver
                known = {r.b for r in refs.select(self._bucket("file_id").alias("b")).distinct().collect()}
                new = new.join(self.table("refs", known).select("src_table", "row_id"), ["src_table", "row_id"], "left_anti")
        pair = ThreadPoolExecutor(2)  # either two tables are written at the same time
        a = pair.submit(self._write, log, "id", f"{at}/parents") if new_parents is not None or deleted is not None else None
        b = pair.submit(self._write, new, "file_id", f"{at}/refs") if new is not None else None
        changed, came = a.result() if a else set(), b.result() if b else set()
        keep("parents", f"{at}/parents", changed)
        keep("refs", f"{at}/refs", came)
        now = OrphanState(self.spark, self.folder, self.buckets, self.version + 1, where)
        begun = starts(now.table("parents", changed | came))

        b = pair.submit(self._write, probe(self._part("refs", f"{at}/refs", came), begun), "file_id", f"{at}/opened") if came else None
        if changed and old["refs"]:
            # arriving parents resolve or withdraw the orphans that wait for them, deletions reopen references
            keys = self._part("parents", f"{at}/parents", changed).select(F.col("id").alias("file_id")).distinct()
            again = self.table("refs", changed).join(keys, "file_id", "left_semi").select("src_table", "row_id", "file_id", "at")
            still = self.table("pending", changed).join(keys, "file_id", "left_anti").select("src_table", "row_id", "file_id", "at", "resolved_at")
            left = self._write(still.unionByName(probe(again, begun)), "file_id", f"{at}/pending")
            for k in changed:
                where["pending"].pop(k, None)
            keep("pending", f"{at}/pending", left, True)
        keep("pending", f"{at}/opened", b.result() if b else set())
        pair.shutdown()

        touched = changed | came
        for name, key in (("refs", "file_id"), ("parents", "id"), ("pending", "file_id")):
            many = {b for b in touched if len(where[name].get(b, [])) > MERGE}
            if many:
                keep(name, f"{at}/{name}-merged", self._write(now.table(name, many).distinct(), key, f"{at}/{name}-merged"), True)
        Folder(self.spark, at).write("MANIFEST", json.dumps({"buckets": self.buckets, "where": where}))
        return now

    def snapshot(self, period: str = "month", waiting_only: bool = False) -> DataFrame:
        return snapshot(self.pending, period, waiting_only)


def snapshot(pending: DataFrame, period: str = "month", waiting_only: bool = False) -> DataFrame:
    """Orphans by table and period of the referring row's time; `waiting` are those without a parent yet."""
    rows = pending.where(F.col("resolved_at").isNull()) if waiting_only else pending
    return rows.groupBy("src_table", F.date_trunc(period, F.col("at").cast("timestamp_ntz")).cast("timestamp_ntz").alias("period")).agg(
        F.count(F.lit(1)).alias("orphans"),
        F.count(F.when(F.col("resolved_at").isNull(), 1)).alias("waiting"),
    )


def replay(state: OrphanState, refs: DataFrame, new_parents: DataFrame, deleted: DataFrame | None = None, batches: int = 2) -> OrphanState:
    """The state after a whole history, delivered in batches by the rows' times: equal spans between the first and the
    last time of a reference."""
    first, last = refs.agg(F.min("at"), F.max("at")).first()
    if first is None or batches < 2:
        return state.advance(refs, new_parents, deleted)
    bounds = [None, *(first + (last - first) * k / batches for k in range(1, batches)), None]

    def between(df: DataFrame | None, at: str, a: object, b: object) -> DataFrame | None:
        if df is None:
            return None
        if a is not None:
            df = df.where(F.col(at) >= F.lit(a).cast("timestamp_ntz"))
        return df if b is None else df.where(F.col(at) < F.lit(b).cast("timestamp_ntz"))

    for a, b in zip(bounds, bounds[1:], strict=False):
        state = state.advance(between(refs, "at", a, b), between(new_parents, "since", a, b), between(deleted, "gone", a, b))
    return state
