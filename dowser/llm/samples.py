"""Bounded samples to fit models on, and models kept in the shared folder.

A sample is the rows whose keys have the least hashes. They are found by a threshold on the hash, so nothing but rows of
the sample leaves the scan and no task sorts texts.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dowser.session import ensure_checkpoint_dir

#: Texts above this many characters are left out of the samples that models are fitted on, which bounds a sample's size.
MOST_CHARS = 20_000
_FULL = 1 << 62


def sample(df: DataFrame, key: str, columns: Sequence[str], rows: int, usable: Column) -> pa.Table:
    """At most `rows` usable rows, each key once, with the least hashes of their keys, in that order.

    The share of keys that is asked for begins at a few times what is wanted, and grows until there are enough.
    """
    total = df.count()
    share = 1.0 if total <= 3 * rows else 3 * rows / total
    hashed = df.where(usable & F.col(key).isNotNull()).select(key, *(c for c in columns if c != key), F.pmod(F.xxhash64(F.col(key)), F.lit(_FULL)).alias("_hash"))
    while True:
        part = hashed if share >= 1 else hashed.where(F.col("_hash") < F.lit(int(share * _FULL)))
        got = part.dropDuplicates([key]).toArrow() if share < 1 or total <= 3 * rows else part.dropDuplicates([key]).orderBy("_hash", key).limit(rows).toArrow()
        if share >= 1 or got.num_rows >= rows:
            order = pc.sort_indices(got, sort_keys=[("_hash", "ascending"), (key, "ascending")])[:rows]
            return got.take(order).select(list(columns))
        share = min(1.0, share * max(2.0, 1.5 * rows / max(1, got.num_rows)))


_kept: dict[str, object] = {}


def fitted(spark: SparkSession, name: str, given: object, fit: Callable[[], object]) -> object:
    """The model of `fit`, from the shared folder if one was fitted on the same sample and parameters (`given`)."""
    digest = hashlib.sha256(pickle.dumps((name, given), protocol=4)).hexdigest()[:32]
    if digest in _kept:
        return _kept[digest]
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/{name}-{digest}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path):
        stream = fs.open(path)
        model = pickle.loads(bytes(stream.readAllBytes()))
        stream.close()
    else:
        model = fit()
        stream = fs.create(path, True)
        stream.write(bytearray(pickle.dumps(model, protocol=4)))
        stream.close()
    _kept[digest] = model
    return model
