"""Filters, counts, pages and look-ups over the index tables, and changes as functions from tables to tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from dowser import schemas as S
from dowser.functions import exprs as X


def latest(files: DataFrame, *columns: str, key: str = "id", version: str = "update_time") -> DataFrame:
    """One row a key with its latest version of some columns; versions with the same time agree."""
    keep = [c for c in columns if c != key]
    got = files.groupBy(key).agg(F.max(F.struct(F.col(version).alias("_v"), *keep)).alias("r"))
    return got.select(key, *(F.col("r")[c].alias(c) for c in keep))


# --- filters, counts and pages ------------------------------------------------------------------------------------


def page(df: DataFrame, number: int, size: int, *order: object) -> DataFrame:
    """Page `number`, from 1, in a total order."""
    return df.orderBy(*order).offset(max(0, number - 1) * size).limit(size)


def unindexed(files: DataFrame, category: int, after: int = 0) -> DataFrame:
    """Files of a category that wait to be indexed, after an id: one keyset step without its limit."""
    return files.where((F.col("content_index_status") == S.WAITING) & (F.col("category") == category) & (F.col("id") > after))


def keyset(files: DataFrame, category: int, after: int, size: int = 1000) -> DataFrame:
    return unindexed(files, category, after).orderBy("id").limit(size)


def updated_since(files: DataFrame, since) -> DataFrame:
    return files.where(F.col("update_time") > F.lit(since))


def lookup(df: DataFrame, column: str, value: object) -> Row | None:
    """The first row with the value, or None."""
    got = df.where(F.col(column) == F.lit(value)).take(1)
    return got[0] if got else None


def require(df: DataFrame, column: str, value: object) -> Row:
    row = lookup(df, column, value)
    if row is None:
        raise KeyError(f"no row with {column} = {value!r}")
    return row


def chunks(content: DataFrame, ids: Sequence[int]) -> DataFrame:
    """The chunks' texts in the order of their index; no ids, no rows."""
    return content.where(F.col("id").isin(*ids) if ids else F.lit(False)).select("id", "chunk_index", "chunk_text").dropDuplicates(["id"]).orderBy("chunk_index", "id")


def sorted_page(df: DataFrame, column: str, ascending: bool, number: int, size: int, allowed: Sequence[str], key: str = "id") -> DataFrame:
    """A page by a column out of a list of allowed ones."""
    if column not in allowed:
        raise ValueError(f"cannot sort by {column!r}")
    return page(df, number, size, F.asc_nulls_first(column) if ascending else F.desc_nulls_last(column), F.asc(key))


def path_page(files: DataFrame, number: int, size: int, ascending: bool = True) -> DataFrame:
    """A page of the paths alone, in the order of ids."""
    return page(files.select("id", "path"), number, size, F.asc("id") if ascending else F.desc("id")).select("path")


def model_by_name(models: DataFrame, name: str, platform: str) -> Row | None:
    return lookup(models.where(F.col("platform") == platform), "name", name)


def by_names(df: DataFrame, names: Sequence[str] | None, column: str = "name") -> DataFrame:
    """The rows with one of the names; None: all of them; no names, no rows."""
    return df if names is None else df.where(F.col(column).isin(*names) if names else F.lit(False))


def model_by_type(models: DataFrame, kind: str, platform: str) -> DataFrame:
    """The first enabled model of a platform that lists the type among its own."""
    return models.where(F.col("model_types").contains(kind) & (F.col("platform") == platform) & F.col("is_enable")).orderBy("id").limit(1)


# --- changes ------------------------------------------------------------------------------------------------------


def overlay(df: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """The table with the columns of `changes` (one row a key) written over, where a change has the key and a value."""
    fields = [c for c in changes.columns if c != key]
    renamed = changes.select(F.col(key), *(F.col(c).alias(f"_new_{c}") for c in fields))
    joined = df.join(renamed, key, "left")
    return joined.select(*(F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns))


def append(df: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """New rows with keys after the greatest. The rows are numbered by one counter a partition, so keys are unique and
    ascending, but not dense."""
    top = df.agg(F.coalesce(F.max(key), F.lit(0)).alias("m")).first()["m"]
    return df.unionByName(rows.withColumn(key, F.lit(top) + 1 + F.monotonically_increasing_id()), allowMissingColumns=True)


def delete_prefix(files: DataFrame, directory: str, separator: str = "/") -> DataFrame:
    """What is left without a directory: its own row and all below it."""
    same = F.col("path") == directory
    return files.where(~F.coalesce(same | X.under_directory("path", directory, separator), F.lit(False)))


def delete_embeddings_of(embeddings: DataFrame, files: DataFrame, directory: str, separator: str = "/") -> DataFrame:
    """The embeddings without those of the files below a directory."""
    gone = files.where(X.under_directory("path", directory, separator)).select(F.col("id").alias("file_id")).distinct()
    return embeddings.join(gone, "file_id", "left_anti").select(*embeddings.columns)


def delete_file(files: DataFrame, content: DataFrame, meta: DataFrame, file_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without a file. Ids below 1 delete nothing."""
    if file_id < 1:
        return files, content, meta
    left = ~F.coalesce(F.col("file_id") == file_id, F.lit(False))
    return files.where(F.col("id") != file_id), content.where(left), meta.where(left)


def remove_directory(files: DataFrame, content: DataFrame, meta: DataFrame, directory: str, separator: str = "/") -> tuple[DataFrame, DataFrame, DataFrame]:
    return (delete_prefix(files, directory, separator), delete_embeddings_of(content, files, directory, separator),
            delete_embeddings_of(meta, files, directory, separator))


def rename_file(files: DataFrame, old: str, new: str) -> DataFrame:
    hit = F.col("path") == old
    return files.withColumns({"name": F.when(hit, X.file_name(F.lit(new))).otherwise(F.col("name")), "path": F.when(hit, F.lit(new)).otherwise(F.col("path"))})


def reroot(files: DataFrame, old: str, new: str, separator: str = "/") -> DataFrame:
    """Paths below the old directory with every occurrence of it replaced."""
    return files.withColumn("path", F.when(X.under_directory("path", old, separator), F.replace(F.col("path"), F.lit(old), F.lit(new))).otherwise(F.col("path")))


def set_status(files: DataFrame, ids: Sequence[int], content: int | None = None, meta: int | None = None, message: str = "") -> DataFrame:
    hit = F.col("id").isin(*ids) if ids else F.lit(False)
    for field, value in (("content_index_status", content), ("meta_index_status", meta)):
        if value is not None:
            files = files.withColumns({field: F.when(hit, F.lit(value)).otherwise(F.col(field)), f"{field}_msg": F.when(hit, F.lit(message)).otherwise(F.col(f"{field}_msg"))})
    return files


def upsert_plan(scan: DataFrame, files: DataFrame) -> DataFrame:
    """(path, id, action) of every scanned path: 'new'; 'skip' if indexed and not modified since; else 'update'.
    scan(path, modified); of two rows of one path the latest counts on either side."""
    seen = scan.groupBy("path").agg(F.max("modified").alias("modified"))
    known = files.groupBy("path").agg(F.max(F.struct("file_update_time", "id", "content_index_status")).alias("f"))
    current = (F.col("f.content_index_status") == S.INDEXED) & (F.col("f.file_update_time") >= F.col("modified"))
    return seen.join(known, "path", "left").select("path", F.col("f.id").alias("id"), F.when(F.col("f").isNull(), "new").when(current, "skip").otherwise("update").alias("action"))


def apply_upsert(scan: DataFrame, files: DataFrame, requeue: bool = True) -> DataFrame:
    """The file table after a scan. scan has path, modified and any of the table's columns. With `requeue`, files that
    changed wait to be indexed again; without it they keep their status."""
    plan = upsert_plan(scan, files)
    fields = [c for c in scan.columns if c in files.columns and c not in ("id", "path")]
    rows = scan.dropDuplicates(["path"]).join(plan, "path")
    change = rows.where("action = 'update'").select("id", F.col("modified").alias("file_update_time"), *(c for c in fields if c != "file_update_time"))
    if requeue:
        change = change.withColumns({"content_index_status": F.lit(S.WAITING), "meta_index_status": F.lit(S.WAITING)})
    fresh = rows.where("action = 'new'").select("path", F.col("modified").alias("file_update_time"), *(c for c in fields if c != "file_update_time")).withColumns(
        {"name": X.file_name("path"), "file_ext": X.file_ext("path"), "category": X.category(X.file_ext("path")), "content_index_status": F.lit(S.WAITING),
         "meta_index_status": F.lit(S.WAITING), "is_invalid": F.lit(False)})
    return append(overlay(files, change), fresh)


def insert_or_ignore(config: DataFrame, rows: DataFrame, key: str = "name") -> DataFrame:
    return append(config, rows.dropDuplicates([key]).join(config.select(key), key, "left_anti"))


def columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Some of the columns, by name; none or an unknown one is an error."""
    unknown = [n for n in names if n not in df.columns]
    if not names or unknown:
        raise ValueError(f"no such columns: {unknown}")
    return df.select(*names)


def stale(files: DataFrame, listed: DataFrame) -> DataFrame:
    """Files whose path is not listed any more."""
    return files.join(listed.select("path").distinct(), "path", "left_anti")


def below(files: DataFrame, directories: DataFrame) -> DataFrame:
    """(id, directory) of each file below one of the directories(path), with the deepest of them. An equi-join on the
    files' ancestors; unlike a prefix predicate it is literal and case-sensitive."""
    up = files.where(F.length("path") > 0).select("id", F.explode(X.ancestors("path")).alias("directory"))
    hit = up.join(directories.select(F.col("path").alias("directory")).distinct(), "directory")
    return hit.groupBy("id").agg(F.max_by("directory", F.length("directory")).alias("directory"))


def removed_ids(files: DataFrame, removed: DataFrame) -> DataFrame:
    """(id) of the removed(path, is_file) files, and of all that is below removed directories."""
    same = files.join(removed.select("path").distinct(), "path", "left_semi").select("id")
    return same.unionByName(below(files, removed.where(~F.coalesce("is_file", F.lit(True)))).select("id")).distinct()


def apply_removals(files: DataFrame, content: DataFrame, meta: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the removed(path, is_file) files, and without all that is below removed directories."""
    gone = removed_ids(files, removed)
    owner = gone.select(F.col("id").alias("file_id"))
    return (files.join(gone, "id", "left_anti").select(*files.columns), *(t.join(owner, "file_id", "left_anti").select(*t.columns) for t in (content, meta)))


def renamed(files: DataFrame, renames: DataFrame) -> DataFrame:
    """(id, path, name) of the files that renames(path, to_path) move: the file itself, or else what is below a
    directory, in whose paths every occurrence of the old one is replaced and whose names stay."""
    to = renames.where(F.col("to_path").isNotNull()).groupBy("path").agg(F.min("to_path").alias("to_path"))
    own = files.select("id", "path").join(to, "path").select("id", F.col("to_path").alias("path"), X.file_name("to_path").alias("name"))
    moved = below(files, to).join(to.select(F.col("path").alias("directory"), "to_path"), "directory")
    within = moved.join(files.select("id", "path", "name"), "id").select("id", F.replace(F.col("path"), F.col("directory"), F.col("to_path")).alias("path"), "name")
    return own.unionByName(within.join(own.select("id"), "id", "left_anti"))


def apply_renames(files: DataFrame, renames: DataFrame) -> DataFrame:
    """Files with the renames applied."""
    return overlay(files, renamed(files, renames))
