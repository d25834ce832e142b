"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(name: str = "dowser", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; `conf` overrides them (dots as double underscores)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. A machine-local one is set only in local mode,
    where all executors are on this machine."""
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    folder = named or tempfile.mkdtemp(prefix="dowser-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


class Folder:
    """Small files and names in a folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, str(path)
        self._path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str) -> Folder:
        return Folder(self.spark, f"{self.path.rstrip('/')}/{name}")

    def _of(self, name: str):
        return self.at(name)._path if name else self._path

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._of(name))

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path)) if self.exists() else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._of(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str, replace: bool = True) -> bool:
        """Written under another name and then renamed, so that it is there whole or not at all. Without `replace`,
        false if it is there already."""
        part = self._of(f".{name}.{uuid.uuid4().hex}")
        stream = self._fs.create(part, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if replace and self.exists(name):
            self._fs.delete(self._of(name), False)
        done = not self.exists(name) and self._fs.rename(part, self._of(name))
        if not done:
            self._fs.delete(part, False)
        return done

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._of(name), True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, which survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def temporary_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, which is removed when the driver's program ends."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            Folder(spark, folder).delete()
        except Exception:  # the session has ended
            pass

    atexit.register(remove)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, compressed; for what is read more than once and is large. The table
    is removed when the driver's program ends."""
    folder = temporary_folder(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
