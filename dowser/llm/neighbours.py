"""Most similar vectors for every vector by multi-index hashing.

Vectors become binary codes: learned rotations (iterative quantisation, fitted on a bounded sample) and a sign for each
rotated number. A code is split into substrings and each substring is indexed. Two codes that differ in few bits must
agree, up to one bit, in some substring (pigeonhole), so probing every substring's index at radius 1 retrieves every
code within a Hamming radius of twice the number of substrings less one, and most of those beyond. What is within
`hamming` bits is reranked by the floats.

A substring's index is cut into blocks by its leading bits, so that a block holds about `block_rows` vectors however
many there are. A vector is sent to its own block of every substring and, for probes that change a leading bit from 0
to 1, to that neighbouring block. Exact copies are collapsed first to one representative with its k + 1 smallest ids,
which is all that a list of k neighbours can need; hot copies are cut to these before they are shuffled. A block that
holds far more than its share, since many vectors are alike, is cut into chunks, and every two chunks meet in a task.

The index answers for near vectors only: beyond some distance, codes say too little. `nearest` gives the k nearest at
any distance by an exact pass, in which every representative meets every block of the others.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dowser.llm import samples
from dowser.session import cut_lineage

WORDS, SUB_BITS = 2, 20
HAMMING = 28
SAMPLE = 4000
BLOCK_ROWS = 250_000
EXACT_ROWS = 200_000
CHUNK = 1 << 19


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, unit vectors) of those lists that have `dim` finite numbers that are not all zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)  # null numbers become nan
    good = (np.diff(offsets) == dim) & column.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(good)
    x = values[offsets[:-1][rows, None] + np.arange(dim)].astype(np.float32) + np.float32(0)
    norm = np.linalg.norm(x.astype(np.float64), axis=1)
    fine = np.isfinite(norm) & (norm > 0)
    return rows[fine], (x[fine] / norm[fine, None]).astype(np.float32)


def rotations(sample: np.ndarray, words: int = WORDS, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """A dim x (64 * words) matrix: for each word of 64 bits a learned rotation of the principal components."""
    rng, dim = np.random.default_rng(seed), sample.shape[1]
    x = sample.astype(np.float64)
    if len(x) < 2:
        return rng.standard_normal((dim, 64 * words))
    _, basis = np.linalg.eigh(np.cov(x.T))
    out = []
    for _ in range(math.ceil(64 * words / dim)):
        turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        v = (x - x.mean(0)) @ basis
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.sign(v @ turn).T @ v)
            turn = (u @ w).T
        out.append(basis @ turn)
    return np.concatenate(out, axis=1)[:, : 64 * words]


def codes(unit: np.ndarray, turn: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """uint64 code words, one row a vector."""
    bits = ((unit - centre) @ turn) > 0
    return np.packbits(bits.reshape(len(unit), -1, 64), axis=2, bitorder="little").view(np.uint64)[:, :, 0]


@dataclass
class Hasher:
    dim: int
    turn: np.ndarray
    centre: np.ndarray

    @staticmethod
    def fit(df: DataFrame, key: str, vector: str, dim: int, sample: int = SAMPLE, words: int = WORDS) -> Hasher:
        """Fitted on `sample` rows, those with the least hashes of their keys."""
        _, unit = matrix(samples.sample(df, key, [vector], sample, F.size(vector) == dim).column(0), dim)
        turn = rotations(unit, words)
        return Hasher(dim, turn.astype(np.float32), (unit.mean(0) if len(unit) else np.zeros(dim)).astype(np.float32))


def hashed(df: DataFrame, key: str, vector: str, hasher: Hasher) -> DataFrame:
    """(id, copy, c0, c1, ...) of each row with a usable vector; `copy` is a hash of the vector itself."""
    words = hasher.turn.shape[1] // 64
    mix = np.random.default_rng(11).integers(1, 1 << 63, hasher.dim, dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, unit = matrix(batch.column(1), hasher.dim)
            if not len(rows):
                continue
            c = codes(unit, hasher.turn, hasher.centre).view(np.int64)
            z = unit.view(np.uint32).astype(np.uint64) * mix
            copy = ((z ^ (z >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)).sum(axis=1, dtype=np.uint64).view(np.int64)
            ids = batch.column(0).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(copy), *(pa.array(np.ascontiguousarray(c[:, w])) for w in range(words))],
                names=["id", "copy", *(f"c{w}" for w in range(words))])

    schema = "id bigint, copy bigint, " + ", ".join(f"c{w} bigint" for w in range(words))
    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), vector).mapInArrow(run, schema)


def collapsed(rows: DataFrame, words: int, k: int) -> DataFrame:
    """(id, lead, c0, ...): one representative of each group of copies, with the group's k + 1 smallest ids."""
    same = ["copy", *(f"c{w}" for w in range(words))]
    first = rows.withColumn("_n", F.dense_rank().over(Window.partitionBy(*same).orderBy("id"))).where(F.col("_n") <= k + 1)
    return first.groupBy(*same).agg(F.array_sort(F.collect_set("id")).alias("lead")).withColumn("id", F.col("lead")[0])


def spread(reps: DataFrame, words: int, sub_bits: int, lead_bits: int) -> DataFrame:
    """(block, home, id, c0, ...): each vector in its block of every substring, and as a visitor in the others."""
    per, low = 64 // sub_bits, sub_bits - lead_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = [batch.column(1 + w).to_numpy().view(np.uint64) for w in range(words)]
            n = batch.num_rows
            for j in range(per * words):
                sub = (c[j // per] >> np.uint64(j % per * sub_bits)) & np.uint64((1 << sub_bits) - 1)
                top = (sub >> np.uint64(low)).astype(np.int64)
                parts = [(np.arange(n), top, True)]
                for bit in range(lead_bits):
                    zero = np.flatnonzero(top >> bit & 1 == 0)
                    parts.append((zero, top[zero] | 1 << bit, False))
                for rows, block, home in parts:
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(((j << lead_bits) + block).astype(np.int32)), pa.array(np.full(len(rows), home)),
                         *(batch.column(i).take(at) for i in range(1 + words))],
                        names=["block", "home", "id", *(f"c{w}" for w in range(words))])

    columns = [f"c{w}" for w in range(words)]
    schema = "block int, home boolean, id bigint, " + ", ".join(f"{c} bigint" for c in columns)
    return reps.select("id", *columns).mapInArrow(run, schema)


def ranges(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for every i and every j of lo[i] to hi[i] - 1, in chunks of bounded size."""
    count = hi - lo
    live = np.flatnonzero(count > 0)
    at = 0
    while at < len(live):
        total = np.cumsum(count[live[at : at + CHUNK]])
        upto = max(1, int(np.searchsorted(total, CHUNK, "right")))
        part = live[at : at + upto]
        if upto == 1 and count[part[0]] > CHUNK:  # one probe that meets very many
            for j in range(lo[part[0]], hi[part[0]], CHUNK):
                js = np.arange(j, min(j + CHUNK, hi[part[0]]))
                yield np.full(len(js), part[0]), js
        else:
            n = count[part]
            i = np.repeat(part, n)
            yield i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + lo[i]
        at += upto


def block_pairs(ids: np.ndarray, words: list[np.ndarray], home: np.ndarray, block: int, sub_bits: int, lead_bits: int, hamming: int, chunk: np.ndarray | None = None):
    """Pairs of ids in a block whose substrings differ in one bit at most and whose codes in `hamming` at most;
    with `chunk`, only those of two chunks."""
    per, low = 64 // sub_bits, sub_bits - lead_bits
    j = block >> lead_bits
    sub = ((words[j // per] >> np.uint64(j % per * sub_bits)) & np.uint64((1 << low) - 1)).astype(np.int64)
    order = np.argsort(sub[home], kind="stable")
    at_home = np.flatnonzero(home)[order]
    hsub, hid, hw = sub[at_home], ids[at_home], [w[at_home] for w in words]
    part = np.zeros(len(ids), np.int32) if chunk is None else chunk
    hpart = part[at_home]
    start = np.concatenate([[0], np.cumsum(np.bincount(hsub, minlength=1 << low))])
    probes = [(hid, hw, hpart, np.arange(len(hsub)) + 1, start[hsub + 1])]
    for bit in range(low):
        zero = np.flatnonzero(hsub >> bit & 1 == 0)
        to = hsub[zero] | 1 << bit
        probes.append((hid[zero], [w[zero] for w in hw], hpart[zero], start[to], start[to + 1]))
    guests = np.flatnonzero(~home)
    if len(guests):
        to = sub[guests]
        probes.append((ids[guests], [w[guests] for w in words], part[guests], start[to], start[to + 1]))
    for pid, pw, ppart, lo, hi in probes:
        for a, b in ranges(lo, hi):
            if chunk is not None:
                apart = ppart[a] != hpart[b]
                a, b = a[apart], b[apart]
            apart = np.bitwise_count(pw[0][a] ^ hw[0][b]).astype(np.int16)
            for w in range(1, len(words)):
                apart += np.bitwise_count(pw[w][a] ^ hw[w][b])
            near = np.flatnonzero(apart <= hamming)
            if len(near):
                x, y = pid[a[near]], hid[b[near]]
                yield np.minimum(x, y), np.maximum(x, y)


def candidates(reps: DataFrame, words: int = WORDS, sub_bits: int = SUB_BITS, hamming: int = HAMMING,
               rows: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b), a < b: pairs of representatives that some probe retrieves within the Hamming radius."""
    rows = reps.count() if rows is None else rows
    lead_bits = min(sub_bits - 4, max(0, math.ceil(math.log2(max(1, rows) / block_rows))))

    sent = spread(reps, words, sub_bits, lead_bits)
    # one number a block goes to the driver; there are about 1 / block_rows as many as vectors
    hot = {r["block"]: math.ceil(r["count"] / (2 * block_rows)) for r in sent.groupBy("block").count().where(F.col("count") > 4 * block_rows).collect()}

    def run(group: pa.Table) -> pa.Table:
        ids, block = group.column("id").to_numpy(), group.column("block")[0].as_py()
        c = [group.column(f"c{w}").to_numpy().view(np.uint64) for w in range(words)]
        chunk = group.column("chunk").to_numpy()
        across = group.column("first")[0].as_py() != group.column("second")[0].as_py()
        out = list(block_pairs(ids, c, group.column("home").to_numpy(), block, sub_bits, lead_bits, hamming, chunk if across else None))
        a = np.concatenate([x for x, _ in out]) if out else np.zeros(0, np.int64)
        b = np.concatenate([y for _, y in out]) if out else np.zeros(0, np.int64)
        return pa.table({"a": a, "b": b})

    chunks = F.element_at(F.create_map(*[F.lit(x) for kv in hot.items() for x in kv]), F.col("block")) if hot else F.lit(None).cast("int")
    sent = sent.withColumn("chunks", F.coalesce(chunks, F.lit(1))).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    sent = sent.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    sent = sent.select("block", "home", "id", *(f"c{w}" for w in range(words)), "chunk", F.least("chunk", "other").alias("first"), F.greatest("chunk", "other").alias("second"))
    return sent.groupBy("block", "first", "second").applyInArrow(run, "a bigint, b bigint").distinct()


def distances(pairs: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """(a, b, distance): the cosine distance of each pair. vectors(id, v): each id may come more than once."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    own = vectors.join(ids, "id", "left_semi").dropDuplicates(["id"])
    both = (pairs.join(own.select(F.col("id").alias("a"), F.col("v").alias("va")), "a")
            .join(own.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(i).flatten().to_numpy().astype(np.float64).reshape(-1, dim) for i in (2, 3))
            cos = (x * y).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(1 - cos)], names=["a", "b", "distance"])

    return both.select("a", "b", "va", "vb").mapInArrow(run, "a bigint, b bigint, distance double")


def near(df: DataFrame, key: str = "id", vector: str = "embedding", dim: int = 64, k: int = 5, within: float = 0.05,
         words: int = WORDS, sub_bits: int = SUB_BITS, hamming: int = HAMMING, sample: int = SAMPLE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, neighbour, distance, rank): of each vector the k nearest others within a distance.

    Vectors that are null, of another length, all zero or not finite take no part; a key that comes twice counts
    once. Ties go to the smaller id. Of a group of exact copies, those beyond the k + 1 smallest ids have the k
    smallest as neighbours and are nobody's, so they are left out here: `copies` gives their membership. Neighbours
    further than the index reaches are not found, whatever `within` is: `nearest` finds them.
    """
    hasher = Hasher.fit(df, key, vector, dim, sample, words)
    reps = cut_lineage(collapsed(hashed(df, key, vector, hasher), words, k))
    # a group of more than k copies has no place for others in its lists, but may be in the lists of others
    found = cut_lineage(candidates(reps, words, sub_bits, hamming, reps.count(), block_rows))
    vectors = df.where(F.size(vector) == dim).select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"))
    close = distances(found, vectors, dim).where(F.col("distance") <= within)
    lead = reps.select("id", "lead")
    between = (close.join(lead.select(F.col("id").alias("a"), F.col("lead").alias("la")), "a")
               .join(lead.select(F.col("id").alias("b"), F.col("lead").alias("lb")), "b")
               .select(F.explode("la").alias("x"), "lb", "distance").select("x", F.explode("lb").alias("y"), "distance"))
    both = between.select(F.col("x").alias("id"), F.col("y").alias("neighbour"), "distance").unionByName(
        between.select(F.col("y").alias("id"), F.col("x").alias("neighbour"), "distance"))
    within_group = (lead.where(F.size("lead") > 1).select(F.explode("lead").alias("id"), "lead")
                    .select("id", F.explode("lead").alias("neighbour"), F.lit(0.0).alias("distance")).where("id <> neighbour"))
    order = Window.partitionBy("id").orderBy("distance", "neighbour")
    return both.unionByName(within_group).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def usable(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(id, copy, v) of each row with a usable vector: a digest of the unit vector and the float32 bytes as they came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, unit = matrix(batch.column(1), dim)
            if not len(rows):
                continue
            at = pa.array(rows)
            x = batch.column(1).take(at).flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            offsets = np.arange(len(rows) + 1, dtype=np.int32) * (4 * dim)
            v = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(x)])
            copy = pa.array([hashlib.md5(u).digest() for u in unit], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), copy, v], names=["id", "copy", "v"])

    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), vector).mapInArrow(run, "id bigint, copy binary, v binary")


def membership(rows: DataFrame, k: int) -> DataFrame:
    """(id, representative, lead) of every id of usable(): the least id with the same vector, and, with the
    representative itself only, the k + 1 least."""
    own = rows.groupBy("id").agg(F.min("copy").alias("copy"))
    first = own.withColumn("_n", F.row_number().over(Window.partitionBy("copy").orderBy("id"))).where(F.col("_n") <= k + 1)
    lead = first.groupBy("copy").agg(F.array_sort(F.collect_list("id")).alias("lead"))
    return own.join(lead, "copy").select("id", F.col("lead")[0].alias("representative"), F.when(F.col("id") == F.col("lead")[0], F.col("lead")).alias("lead"))


def copies(df: DataFrame, key: str = "id", vector: str = "embedding", dim: int = 64) -> DataFrame:
    """(id, representative) of every row that has exact copies, the representative included."""
    every = membership(usable(df, key, vector, dim), 1)
    several = every.where(F.size("lead") > 1).select("representative")
    return every.select("id", "representative").join(several, "representative", "left_semi").select("id", "representative")


def block_nearest(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, k: int, rows: int = 256, columns: int = 1 << 15):
    """Yields (id, other, distance): of each of `ids` the k nearest of `others` besides itself, ties to the smaller
    id. A float32 product leaves out what is surely too far; the rest is measured in float64."""
    nx, ny = (np.linalg.norm(z.astype(np.float64), axis=1) for z in (x, y))
    ux, uy = ((z / n[:, None]).astype(np.float32) for z, n in ((x, nx), (y, ny)))
    for lo in range(0, len(ids), rows):
        hi = min(lo + rows, len(ids))
        bi, bj, bd = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        least = np.full(hi - lo, -np.inf, np.float32)
        at, wide = 0, min(columns, 1024)  # a small first tile sets the bound
        while at < len(others):
            s = ux[lo:hi] @ uy[at : at + wide].T
            if at == 0 and s.shape[1] > 4 * (k + 1):
                least = np.partition(s, -(k + 1), axis=1)[:, -(k + 1)] - np.float32(8e-6)
            hit = np.flatnonzero(s >= least[:, None])
            i, j = hit // s.shape[1], hit % s.shape[1] + at
            d = np.empty(len(i))
            for p in range(0, len(i), 1 << 16):
                a, b = i[p : p + (1 << 16)], j[p : p + (1 << 16)]
                d[p : p + (1 << 16)] = 1 - (x[lo + a].astype(np.float64) * y[b].astype(np.float64)).sum(1) / (nx[lo + a] * ny[b])
            away = ids[lo + i] != others[j]
            bi, bj, bd = np.concatenate([bi, i[away]]), np.concatenate([bj, j[away]]), np.concatenate([bd, d[away]])
            order = np.lexsort((others[bj], bd, bi))
            bi, bj, bd = bi[order], bj[order], bd[order]
            rank = np.arange(len(bi)) - np.searchsorted(bi, bi)
            full = rank == k - 1
            # eight millionths are more than float32 products of unit vectors can be wrong by
            least[bi[full]] = (1 - bd[full]).astype(np.float32) - np.float32(8e-6)
            bi, bj, bd = bi[rank < k], bj[rank < k], bd[rank < k]
            at, wide = at + wide, columns
        yield ids[lo + bi], others[bj], bd


def nearest(df: DataFrame, key: str = "id", vector: str = "embedding", dim: int = 64, k: int = 5, block_rows: int = EXACT_ROWS) -> DataFrame:
    """(id, neighbour, distance, rank): of every usable vector the k nearest others, at any distance. Exact.

    The same rows take part as in near(), and ties go to the smaller id; here every copy has its list. Work grows with
    the square of the number of different vectors; the driver and each task hold `block_rows` of them at a time.
    """
    spark = df.sparkSession
    rows = usable(df, key, vector, dim)
    members = cut_lineage(membership(rows, k))
    reps = members.where(F.col("lead").isNotNull())
    n = reps.count()
    tasks = max(4 * spark.sparkContext.defaultParallelism, math.ceil(n / block_rows))
    own = rows.join(reps.select("id"), "id", "left_semi").groupBy("id").agg(F.min(F.struct("copy", "v")).alias("r")).select("id", F.col("r.v").alias("v"))
    own = cut_lineage(own.repartition(tasks, "id"))
    blocks = math.ceil(n / block_rows)

    def unpacked(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)

    lists = None
    for b in range(blocks):
        block = own.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        sent = spark.sparkContext.broadcast((block.column(0).to_numpy(), unpacked(block.column(1))))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            others, y = sent.value
            for batch in batches:
                if batch.num_rows:
                    for i, j, d in block_nearest(batch.column(0).to_numpy(), unpacked(batch.column(1)), others, y, k):
                        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(d)], names=["representative", "other", "distance"])

        part = cut_lineage(own.mapInArrow(run, "representative bigint, other bigint, distance double"))
        sent.destroy()
        lists = part if lists is None else lists.unionByName(part)
    if lists is None:
        return spark.createDataFrame([], "id bigint, neighbour bigint, distance double, rank int")
    several = reps.where(F.size("lead") > 1).select(F.col("id").alias("other"), "lead")
    between = lists.join(several, "other", "left").select("representative", F.explode(F.coalesce("lead", F.array("other"))).alias("neighbour"), "distance")
    within_group = reps.select("representative", F.explode("lead").alias("neighbour"), F.lit(0.0).alias("distance"))
    # at most (blocks * k + 1) * (k + 1) entries a representative
    best = between.unionByName(within_group).groupBy("representative").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))), 1, k + 1).alias("best"))
    each = members.select("id", "representative").join(best, "representative")
    others = F.slice(F.filter("best", lambda e: e["neighbour"] != F.col("id")), 1, k)
    return each.select("id", F.posexplode(others).alias("rank", "e")).select("id", "e.neighbour", "e.distance", (F.col("rank") + 1).alias("rank"))


def mutual(lists: DataFrame) -> DataFrame:
    """(id_a, id_b, distance): pairs of which each is in the other's list."""
    return (lists.groupBy(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("distance")).where("n = 2").drop("n"))
