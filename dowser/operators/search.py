"""Search: exact cosine neighbours of a query vector, multi-keyword path search, and their fusion."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dowser.functions import exprs as X
from dowser.session import stored

K, CUT_OFF, PATH_ROWS = 10, 0.7, 20
PATH_WEIGHT, SEMANTIC_WEIGHT = 0.6, 0.4


def distances(column: pa.Array, query: np.ndarray) -> np.ndarray:
    """1 - cosine of each list to the query, rounded to 6 places so that ties are ties; nan for a null, one of another
    length, an all-zero one or one with nulls."""
    out = np.full(len(column), np.nan)
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    rows = np.flatnonzero((np.diff(offsets) == len(query)) & column.is_valid().to_numpy(zero_copy_only=False))
    size = float(np.sqrt(query @ query))
    if len(rows) and size > 0:
        x = values[offsets[:-1][rows, None] + np.arange(len(query))].astype(np.float64)
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        with np.errstate(divide="ignore", invalid="ignore"):
            out[rows] = np.where(norm > 0, np.round(1 - x @ query / (norm * size), 6), np.nan)
    return out


def knn(vectors: DataFrame, query: Sequence[float], k: int = K, most: float | None = CUT_OFF, vector: str = "embedding") -> DataFrame:
    """(file_id, id, distance): the k nearest of all rows, then those within `most` (None or negative: all of them).

    Each id counts once. Every task holds the k nearest different ids that it has seen and gives these alone, so k rows
    a task are moved: the nearest k of all are among them. No task sorts its rows.
    """
    q = np.array([float(x) for x in query])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[float, int | None]] = {}
        worst = np.inf
        for batch in batches:
            d = distances(batch.column(2), q)
            near = np.flatnonzero(d <= worst) if len(best) >= k else np.flatnonzero(~np.isnan(d))
            if len(near) > 4 * k:  # the k nearest different ids are among those within the k-th different one
                ids = batch.column(1).to_numpy(zero_copy_only=False)[near]
                order = np.argsort(d[near], kind="stable")
                _, first = np.unique(ids[order], return_index=True)
                bound = d[near][order][np.sort(first)[min(k, len(first)) - 1]]
                near = near[d[near] <= bound]
            for i in near.tolist():
                number = batch.column(1)[i].as_py()
                if number is not None and (number not in best or d[i] < best[number][0]):
                    best[number] = (float(d[i]), batch.column(0)[i].as_py())
            if len(best) > k:
                best = dict(sorted(best.items(), key=lambda e: (e[1][0], e[0]))[:k])
            if len(best) == k:
                worst = max(v for v, _ in best.values())
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([f for _, f in best.values()], pa.int64()), pa.array(list(best), pa.int64()), pa.array([v for v, _ in best.values()])], names=["file_id", "id", "distance"])

    rows = vectors.select(F.col("file_id").cast("bigint"), F.col("id").cast("bigint"), vector)
    one = rows.mapInArrow(run, "file_id bigint, id bigint, distance double").dropDuplicates(["id"]).orderBy("distance", "id").limit(k)
    return one if most is None or most < 0 else one.where(F.col("distance") <= most)


def merge_hits(content: DataFrame, meta: DataFrame) -> DataFrame:
    """(file_id, distance, matched_chunk_ids): least distance of each file; only content hits name chunks, nearest first."""
    every = content.select("file_id", "distance", F.col("id").alias("chunk")).unionByName(meta.select("file_id", "distance", F.lit(None).cast("bigint").alias("chunk")))
    hits = F.collect_list(F.when(F.col("chunk").isNotNull(), F.struct("distance", "chunk")))
    return every.groupBy("file_id").agg(F.min("distance").alias("distance"), F.transform(F.array_sort(hits), lambda x: x["chunk"]).alias("matched_chunk_ids"))


def semantic_search(content: DataFrame, meta: DataFrame, files: DataFrame, query: Sequence[float], k: int = K, most: float = CUT_OFF) -> DataFrame:
    """(score, source, file_id, path, matched_chunk_ids): files by least distance; hits whose file is missing are dropped.
    The hits are 2k rows at most, so they are broadcast to the files as they are scanned; of several versions of a
    file the latest counts."""
    merged = merge_hits(knn(content, query, k, most), knn(meta, query, k, most))
    rows = files.select(F.col("id").alias("file_id"), "path", "update_time").join(F.broadcast(merged), "file_id")
    latest = F.max_by(F.struct("path", "distance", "matched_chunk_ids"), "update_time").alias("f")
    found = rows.groupBy("file_id").agg(latest).select("file_id", "f.*")
    return found.select(F.col("distance").alias("score"), F.lit("semantic").alias("source"), "file_id", "path", "matched_chunk_ids").orderBy("score", "file_id")


def path_cache(files: DataFrame) -> DataFrame:
    """(line_num, file_id, path): non-empty paths numbered from 0 in the order of ids.

    Numbering is distributed: rows are range-partitioned by id and stored, the partitions' sizes (one number each) go to
    the driver, and each row's place in its partition is added to its partition's offset.
    """
    rows = files.where(F.coalesce(F.col("path"), F.lit("")) != "").select(F.col("id").alias("file_id"), "path")
    parts = stored(rows.repartitionByRange(F.col("file_id")).withColumn("_part", F.spark_partition_id()))
    offset, offsets = 0, []
    for r in parts.groupBy("_part").count().orderBy("_part").collect():
        offsets.append((r["_part"], offset))
        offset += r["count"]
    start = F.element_at(F.create_map(*[F.lit(x).cast("bigint") for kv in offsets for x in kv]), F.col("_part").cast("bigint")) if offsets else F.lit(0)
    place = F.row_number().over(Window.partitionBy("_part").orderBy("file_id")) - 1
    return parts.select((place + start).cast("bigint").alias("line_num"), "file_id", "path")


def path_search(cache: DataFrame, query: str, limit: int = PATH_ROWS) -> DataFrame:
    """(score, source, line_num, file_id, path, name, file_ext, category, matched_keywords): paths with any of the
    query's words, by number of matches. An empty query finds nothing."""
    return _path_hits(cache, query, "line_num").limit(limit)


def path_search_files(files: DataFrame, query: str, limit: int = PATH_ROWS) -> DataFrame:
    """The same straight from files(id, path), each id once, without a cache: line numbers go by ids, so the hits are
    found by id, and only theirs, `limit` at most, are counted in a second scan."""
    rows = files.where(F.coalesce(F.col("path"), F.lit("")) != "").select(F.col("id").alias("file_id"), "path")
    hits = _path_hits(rows.withColumn("line_num", F.lit(0).cast("bigint")), query, "file_id").limit(limit)
    found = hits.collect()
    if not found:
        return hits
    before = rows.agg(*(F.count_if(F.col("file_id") < r.file_id).alias(f"n{i}") for i, r in enumerate(found))).first()
    return files.sparkSession.createDataFrame([(*r[:2], before[i], *r[3:]) for i, r in enumerate(found)], hits.schema)


def _path_hits(cache: DataFrame, query: str, order: str) -> DataFrame:
    words = query.split()
    if not words:
        return _path_hits(cache, "x", order).where(F.lit(False))
    pattern = X.any_keyword(words)
    hits = F.regexp_extract_all("path", F.lit(pattern), 0)
    found = F.transform(hits, X.ascii_lower)
    first = [w for i, w in enumerate(words) if w.lower() not in {v.lower() for v in words[:i]}]  # of equal words only the first can match
    matched = F.array_compact(F.array(*(F.when(F.array_contains(found, X.ascii_lower(F.lit(w))), F.lit(w)) for w in first)))
    ext = X.file_ext("path")
    return (cache.where(F.col("path").rlike(pattern))
            .select(F.size(hits).cast("double").alias("score"), F.lit("path").alias("source"), "line_num", "file_id", "path",
                    X.file_name("path").alias("name"), ext.alias("file_ext"), X.category(ext).alias("category"), matched.alias("matched_keywords"))
            .orderBy(F.desc("score"), order))


def fuse(paths: DataFrame, semantic: DataFrame, mode: str = "faithful") -> DataFrame:
    """(score, source, path, matched_keywords, matched_chunk_ids), best score first.

    On both sides: 0.6 path + 0.4 semantic, and the path's record stays; path alone: unchanged; semantic alone: 0.4.
    The semantic score is a distance; mode 'similarity' takes 1 - distance instead.
    """
    if mode not in ("faithful", "similarity"):
        raise ValueError(mode)
    p = paths.select("path", F.col("score").alias("ps"), "matched_keywords")
    s = semantic.select("path", (F.col("score") if mode == "faithful" else 1 - F.col("score")).alias("ss"), "matched_chunk_ids")
    both = p.join(s, "path", "full_outer")
    score = (F.when(F.col("ps").isNull(), SEMANTIC_WEIGHT * F.col("ss")).when(F.col("ss").isNull(), F.col("ps"))
             .otherwise(PATH_WEIGHT * F.col("ps") + SEMANTIC_WEIGHT * F.col("ss")))
    alone = F.col("ps").isNull()
    return both.select(
        F.round(score, 6).alias("score"), F.when(alone, "semantic").otherwise("path").alias("source"), "path",
        F.when(alone, F.array().cast("array<string>")).otherwise(F.col("matched_keywords")).alias("matched_keywords"),
        F.when(alone, F.col("matched_chunk_ids")).otherwise(F.array().cast("array<bigint>")).alias("matched_chunk_ids"),
    ).orderBy(F.desc("score"), "path")


def remove_from_cache(cache: DataFrame, path: str, is_file: bool, separator: str = "/") -> DataFrame:
    """Literal and case-sensitive: the path itself, or everything below the directory."""
    return cache.where(F.col("path") != path) if is_file else cache.where(~F.col("path").startswith(path.rstrip(separator) + separator))


def new_paths(cache: DataFrame, files: DataFrame, since) -> DataFrame:
    """(line_num, file_id, path) of the files updated after `since` (None: all) whose path the cache does not hold yet;
    numbers go on after the greatest, in the order of ids, by one counter a partition."""
    rows = files.where(F.coalesce(F.col("path"), F.lit("")) != "")
    rows = rows if since is None else rows.where(F.col("update_time") > F.lit(since))
    fresh = rows.groupBy("path").agg(F.min("id").alias("file_id")).join(cache.select("path"), "path", "left_anti")
    top = cache.agg(F.coalesce(F.max("line_num"), F.lit(-1)).alias("m")).first()["m"]
    return fresh.orderBy("file_id").select((F.lit(top) + 1 + F.monotonically_increasing_id()).alias("line_num"), "file_id", "path")


def refresh_cache(cache: DataFrame, files: DataFrame, since) -> DataFrame:
    """The cached paths and those updated after `since` that it does not hold yet."""
    return cache.unionByName(new_paths(cache, files, since))
