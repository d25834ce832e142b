"""Queries of problem 1: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dowser.operators import references as R
from dowser.tables import table

SOURCES = ("file_content_embedding", "file_metadata_embedding")


def _state(spark: SparkSession, sf_dir: str, deleted: DataFrame | None = None) -> R.OrphanState:
    """The pending-orphan state after the whole history, which comes in batches."""
    refs = None
    for name in SOURCES:
        one = R.references(table(spark, sf_dir, name), name)
        refs = one if refs is None else refs.unionByName(one)
    return R.replay(R.OrphanState.empty(spark), refs, R.parents(table(spark, sf_dir, "file_info")), deleted)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir).pending.select("src_table", "row_id")


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans of each table and month; `waiting` are those whose parent never came."""
    return _state(spark, sf_dir).snapshot()


def p1_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans when the removal events of files count as deletions: (src_table, row_id, resolved_at)."""
    paths = table(spark, sf_dir, "file_info").where("path is not null").select("id", "path").distinct()
    gone = table(spark, sf_dir, "file_event").where("kind = 'remove'").groupBy("path").agg(F.max("ts").alias("ts"))
    return _state(spark, sf_dir, R.deletions(paths.join(gone, "path"))).pending.select("src_table", "row_id", "resolved_at")


_ORPHANS = """
with refs as (
  select 'file_content_embedding' as src_table, id as row_id, file_id, create_time as seen_at from file_content_embedding where file_id is not null
  union
  select 'file_metadata_embedding', id, file_id, create_time from file_metadata_embedding where file_id is not null
), parents as (select id, min(create_time) as since from file_info group by id),
orphans as (
  select r.src_table, r.row_id, r.seen_at, p.since from refs r left join parents p on p.id = r.file_id
  where p.id is null or p.since > r.seen_at
)
"""

_REMOVED = """
with refs as (
  select 'file_content_embedding' as src_table, id as row_id, file_id, create_time as seen_at from file_content_embedding where file_id is not null
  union
  select 'file_metadata_embedding', id, file_id, create_time from file_metadata_embedding where file_id is not null
), gone as (select f.id, max(e.ts) as gone from file_event e join file_info f on f.path = e.path where e.kind = 'remove' group by f.id),
parents as (select f.id, min(f.create_time) filter (where g.gone is null or f.create_time > g.gone) as since
  from file_info f left join gone g on g.id = f.id group by f.id)
select r.src_table, r.row_id, p.since as resolved_at from refs r left join parents p on p.id = r.file_id where p.since is null or p.since > r.seen_at
"""

QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts, "p1_removed": p1_removed}
SQL = {
    "p1_removed": _REMOVED,
    "p1_found": _ORPHANS + "select src_table, row_id from orphans",
    "p1_counts": _ORPHANS + """select src_table, date_trunc('month', seen_at)::timestamp as period, count(*) as orphans,
        count(*) filter (where since is null) as waiting from orphans group by all""",
}
