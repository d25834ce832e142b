"""Scanning roots and looking up paths: files with their metadata, and their bytes read where the tasks run."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dowser.functions import exprs as X
from dowser.session import stored

LISTING = "path string, modified timestamp_ntz, created timestamp_ntz, file_size bigint"


def listing(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """(path, modified, created, file_size) of every file under the roots, empty ones included; a root may be a file.
    Missing roots are empty. No time of creation is known, so it is the epoch.

    Directories are listed level by level, those of one level by many tasks, so the driver holds no listing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                where, at = _opened(path)
                found = where.get_file_info(pafs.FileSelector(at, allow_not_found=True)) if batch.num_columns == 1 else [where.get_file_info(at)]
                lead = path[: len(path) - len(at)] if path.endswith(at) else ""
                for i in range(0, len(found), 10_000):
                    part = [f for f in found[i : i + 10_000] if f.type in (pafs.FileType.File, pafs.FileType.Directory)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lead + f.path for f in part], pa.string()), pa.array([int((f.mtime_ns or 0) // 1000) for f in part], pa.timestamp("us")),
                         pa.array([0] * len(part), pa.timestamp("us")), pa.array([f.size or 0 for f in part], pa.int64()), pa.array([f.type == pafs.FileType.Directory for f in part])],
                        names=["path", "modified", "created", "file_size", "directory"])

    schema = LISTING + ", directory boolean"
    first = spark.createDataFrame([(r, True) for r in sorted({r.rstrip("/\\") or r for r in roots})], "path string, itself boolean")
    level = stored(first.mapInArrow(run, schema))
    out = level.where("not directory")
    while count := (below := level.where("directory")).count():
        level = stored(below.select("path").repartition(min(count, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(run, schema))
        out = out.unionByName(level.where("not directory"))
    return out.drop("directory").dropDuplicates(["path"])


def valid(rows: DataFrame, roots: Sequence[str], ignore_dirs: Sequence[str] = (), ignore_exts: Sequence[str] = (), ignore_files: Sequence[str] = ()) -> DataFrame:
    """The valid files of a listing, with name, extension and category. Hidden and ignored directories below a root are
    left out; the root itself is not tested."""
    hidden = F.lit(False)
    for r in roots:
        base = r if r.endswith("/") else r + "/"
        hidden = hidden | (F.col("path").startswith(base) & X.in_ignored_directory("path", base, ignore_dirs))
    ext = X.file_ext("path")
    named = {"name": X.file_name("path"), "file_ext": ext, "category": X.category(ext)}
    return rows.where(X.valid_file("path", ignore_exts, ignore_files) & ~hidden).withColumns(named)


def scan(spark: SparkSession, roots: Sequence[str], ignore_dirs: Sequence[str] = (), ignore_exts: Sequence[str] = (), ignore_files: Sequence[str] = ()) -> DataFrame:
    """Valid files under the roots: (path, modified, created, file_size, name, file_ext, category); read() adds contents."""
    return valid(listing(spark, roots), roots, ignore_dirs, ignore_exts, ignore_files)


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def write(path: str, data: bytes) -> None:
    """Writes a file, and the directories that it lies in; for tasks."""
    where, at = _opened(path)
    where.create_dir(at.rpartition("/")[0], recursive=True)
    with where.open_output_stream(at) as stream:
        stream.write(data)


def kind_of(path: str) -> str | None:
    """'file' or 'directory', or None where there is neither."""
    where, at = _opened(path)
    return {pafs.FileType.File: "file", pafs.FileType.Directory: "directory"}.get(where.get_file_info(at).type)


def described(paths: DataFrame) -> DataFrame:
    """The valid files among paths(path): (path, name, file_ext, category, modified, created, file_size). They are looked up
    by the tasks that hold the paths; what is no file is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                where, at = _opened(path)
                info = where.get_file_info(at)
                if info.type == pafs.FileType.File:
                    rows.append((path, int((info.mtime_ns or 0) // 1000), info.size or 0))
            if rows:
                path, modified, size = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(modified, pa.timestamp("us")), pa.array([0] * len(rows), pa.timestamp("us")), pa.array(size, pa.int64())],
                                                 names=["path", "modified", "created", "file_size"])

    return valid(paths.select("path").mapInArrow(run, LISTING), [])


def read(df: DataFrame) -> DataFrame:
    """The rows whose file path is still there, with its bytes as `content`; a file at a time, since files may be large."""
    keep = [c for c in df.columns if c != "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.slice(row, 1)
                where, at = _opened(part.column(keep.index("path"))[0].as_py())
                try:
                    with where.open_input_stream(at) as stream:
                        data = stream.read()
                except OSError:  # it vanished since
                    continue
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array([data], pa.binary())], names=[*keep, "content"])

    kinds = dict(df.dtypes)
    return df.select(*keep).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "content binary"]))


def event_log(spark: SparkSession, folder: str, schema, files_per_trigger: int = 64) -> DataFrame:
    """A stream of file events out of a folder of Parquet files; back-pressure instead of dropped events."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
