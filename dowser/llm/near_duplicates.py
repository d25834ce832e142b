"""Near-duplicate texts: T-occurrence search over an inverted index of word triples, after DivideSkip.

Two texts whose triple sets x and y share at least `share` of their union have an overlap of at least
T = share / (1 + share) * (|x| + |y|), so x meets y in at least share * |x| of x's inverted lists. DivideSkip sets the
longest lists aside: of the T that must be met, all but some (`MERGED`, a share of the text's lists) may lie in the long
ones, so y is met at least that often in the others. The short lists are merged and those texts kept that occur often
enough; whether a candidate is in the other lists is then looked up by binary search.

Lists are called long by a table of approximate frequencies, which every worker gets. It has a few cells for each text, up
to a fixed number; the result does not depend on it, since any order that all texts use alike serves. A short list that
may still be very long, since many texts hold hardly anything else, is cut into chunks by the texts' ids, and every two
chunks meet in a task of their own, which gives its meetings as it finds them. So no task holds a list or its pairs
whole. Texts that are equal are collapsed first and come back by membership.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dowser.llm.neighbours import ranges
from dowser.session import cut_lineage, stored

SHARE, WORDS, GRAM = 0.6, 30, 3
#: Cells of the table of frequencies for each text, and the least and most in all: 16 MB are sent to every worker at most.
CELLS_EACH, LEAST_CELLS, MOST_CELLS = 2, 1 << 17, 1 << 22
#: A list that may be longer is cut into chunks of about this many texts.
LONG = 4096
#: The share of a text's lists by which the merged lists are more than the least number that must be met.
MERGED = 0.05
#: Postings of one task of the merge, about.
POSTINGS = 250_000

_words = re.compile("[^ \t\r\n]+").findall


class _Hashes(dict):
    """64-bit hashes of words, kept within bounds."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def grams(text: str, hashes: dict, least_words: int, n: int) -> np.ndarray | None:
    """The set of hashed word n-grams, ascending; None for a text with too few words."""
    words = _words(text.lower())
    if len(words) < max(least_words, n):
        return None
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    m = len(h) - n + 1
    g = np.zeros(m, np.uint64)
    for i in range(n):
        g = (g ^ (g >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[i : i + m]
    return np.unique(g)


def _cell(g: np.ndarray, cells: int) -> np.ndarray:
    return ((g * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)).astype(np.int64) % cells


def representatives(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, h1, h2, text): of each group of equal texts the row with the least key. Null texts take no part.
    A hot text is cut to one row a task before it is shuffled."""
    rows = df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("id"), F.xxhash64(F.col(text)).alias("h1"), F.xxhash64(F.lit(1), F.col(text)).alias("h2"), F.col(text).alias("text"))
    n = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def members(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, rep): each key with a text, once, and the least key with an equal text."""
    rows = df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("id"), F.xxhash64(F.col(text)).alias("h1"), F.xxhash64(F.lit(1), F.col(text)).alias("h2"))
    least = rows.groupBy("h1", "h2").agg(F.min("id").alias("rep"))
    return rows.join(least, ["h1", "h2"]).select("id", "rep").distinct()


def frequencies(reps: DataFrame, least_words: int, n: int, cells: int) -> np.ndarray:
    """How often the cells' n-grams occur in all texts. Its size is `cells`, whatever the input's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hashes = np.zeros(cells, np.int64), _Hashes()
        for batch in batches:
            parts = [g for t in batch.column(0).to_pylist() if (g := grams(t, hashes, least_words, n)) is not None]
            if parts:
                table += np.bincount(_cell(np.concatenate(parts), cells), minlength=cells)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(table[at])], names=["cell", "n"])

    got = reps.select("text").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(cells, np.int64)
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return np.minimum(out, np.iinfo(np.int32).max).astype(np.int32)


def _ordered(g: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The n-grams from the rarest to the most frequent, in an order that all texts share."""
    return g[np.lexsort((g, table[_cell(g, len(table))]))]


def _times(size, merged: float):
    """How often a text must be met in the short lists of one of `size` n-grams."""
    return np.maximum(2, np.floor(size * merged)).astype(np.int64)


def _prefix(size: int, share: float, merged: float) -> int:
    """How many lists are short, for a text of `size` n-grams."""
    return min(size, size - int(np.ceil(share * size - 1e-9)) + int(_times(size, merged)))


def long_list(table: np.ndarray) -> int:
    """From which frequency of a cell on a list is cut: well above what cells have by chance."""
    return max(LONG, 8 * int(table.mean()))


def postings(reps: DataFrame, table, share: float, least_words: int, n: int, merged: float) -> DataFrame:
    """(gram, first, second, chunk, id, size, place): each text in each of its short lists; `place` counts its lists from
    the shortest. 40 bits of the n-gram's hash name the list: lists that fall together only bring candidates. In a
    list that is cut, a text of chunk `chunk` comes once for each two chunks (first, second) of which it is in one."""
    long = long_list(table.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, freq = _Hashes(), table.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                ids, gs, sizes, places = [], [], [], []
                for i, t in zip(batch.column(0).slice(at, 1000).to_pylist(), batch.column(1).slice(at, 1000).to_pylist(), strict=True):
                    g = grams(t, hashes, least_words, n)
                    if g is None:
                        continue
                    short = _ordered(g, freq)[: _prefix(len(g), share, merged)]
                    ids.append(np.full(len(short), i))
                    sizes.append(np.full(len(short), len(g), np.int32))
                    places.append(np.arange(len(short), dtype=np.int32))
                    gs.append(short)
                if ids:
                    gram, number, size, place = map(np.concatenate, (gs, ids, sizes, places))
                    chunks = 1 + freq[_cell(gram, len(freq))].astype(np.int64) // long
                    mixed = number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    chunk = ((mixed >> np.uint64(33)).astype(np.int64) % chunks).astype(np.int32)
                    again = np.repeat(np.arange(len(gram)), chunks)
                    other = np.arange(len(again)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
                    gram, number, size, place, chunk = (x[again] for x in (gram, number, size, place, chunk))
                    for b in range(0, len(gram), 1 << 18):
                        e = slice(b, b + (1 << 18))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array((gram[e] >> np.uint64(24)).astype(np.int64)), pa.array(np.minimum(chunk[e], other[e]).astype(np.int32)), pa.array(np.maximum(chunk[e], other[e]).astype(np.int32)),
                             pa.array(chunk[e]), pa.array(number[e]), pa.array(size[e]), pa.array(place[e])], names=["gram", "first", "second", "chunk", "id", "size", "place"])

    return reps.select("id", "text").mapInArrow(run, "gram bigint, first int, second int, chunk int, id bigint, size int, place int")


def merge(lists: DataFrame, share: float, merged: float, tasks: int) -> DataFrame:
    """(a, b), a < b: texts that occur often enough in each other's short lists.

    Every task merges the lists of its share of the n-grams; occurrences are added up over the tasks. Left out on the
    way are pairs whose sizes alone rule out the overlap, and meetings whose places do: for the smaller of two texts
    only the rarest quarter of its lists are short, as the overlap must be larger against the larger text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches)
        gram, ids, size, place, first, second, chunk = (group.column(c).to_numpy() for c in ("gram", "id", "size", "place", "first", "second", "chunk"))
        order = np.lexsort((ids, size, second, first, gram))
        gram, ids, size, place, first, second, chunk = (x[order] for x in (gram, ids, size, place, first, second, chunk))
        edge = np.flatnonzero((np.diff(gram) != 0) | (np.diff(first) != 0) | (np.diff(second) != 0)) + 1
        start = np.concatenate([[0], edge])
        end = np.concatenate([edge, [len(gram)]])
        stop = np.repeat(end, end - start)
        # within a list sizes ascend: a partner is at most 1 / share times as large
        key = np.repeat(np.arange(len(start)), end - start).astype(np.float64) * (1 << 32)
        stop = np.minimum(stop, np.searchsorted(key + size, key + np.floor(size / share + 1e-9), "right"))
        for i, j in ranges(np.arange(len(gram)) + 1, stop):
            apart = (first[i] == second[i]) | (chunk[i] != chunk[j])  # of two chunks only their texts across
            i, j = i[apart], j[apart]
            need = np.ceil(share / (1 + share) * (size[i] + size[j]) - 1e-9)
            times = np.minimum(_times(np.minimum(size[i], size[j]), merged), need).astype(np.int64)
            # the first `times` lists that the two share have at least need - times shared ones after them
            ok = (np.minimum(size[i] - place[i], size[j] - place[j]) + np.minimum(place[i], place[j]) >= need) & (
                np.maximum(place[i] - size[i], place[j] - size[j]) < times - need) & (ids[i] != ids[j])
            i, j, times = i[ok], j[ok], times[ok]
            if len(i):
                pair, met = _unique(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), times], axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, k])) for k in range(3)] + [pa.array(met)], names=["a", "b", "times", "met"])

    placed = lists.withColumn("part", F.pmod(F.xxhash64("gram", "first", "second"), F.lit(tasks))).repartition(tasks, "part")
    found = placed.groupBy("part").applyInArrow(run, "a bigint, b bigint, times bigint, met bigint")
    return found.groupBy("a", "b", "times").agg(F.sum("met").alias("met")).where(F.col("met") >= F.col("times")).select("a", "b")


def _unique(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort(pair.T[::-1])
    pair = pair[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(pair, axis=0) != 0).any(axis=1)]))
    return pair[first], np.diff(np.concatenate([first, [len(pair)]]))


def verify(pairs: DataFrame, reps: DataFrame, share: float, least_words: int, n: int) -> DataFrame:
    """(a, b, share): the candidates whose sets share enough, each list of one looked up in the other."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            gs = [grams(t, hashes, least_words, n) for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(g) for g in gs])]).astype(np.int32)
            flat = np.concatenate(gs).view(np.int64) if gs else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "grams"])

    own = reps.select("id", "text").join(ids, "id", "left_semi").mapInArrow(sets, "id bigint, grams array<bigint>")
    both = (pairs.join(own.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a")
            .join(own.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b").select("a", "b", "ga", "gb"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = np.zeros(batch.num_rows)
            (xo, x), (yo, y) = ((c.offsets.to_numpy(), c.values.to_numpy().view(np.uint64)) for c in (batch.column(2), batch.column(3)))
            for r in range(batch.num_rows):
                p, q = x[xo[r] : xo[r + 1]], y[yo[r] : yo[r + 1]]
                if len(p) > len(q):
                    p, q = q, p
                hit = np.count_nonzero(q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p)
                shares[r] = hit / (len(p) + len(q) - hit)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shares)], names=["a", "b", "share"])

    return both.mapInArrow(probe, "a bigint, b bigint, share double").where(F.col("share") >= share - 1e-12)


def similar(df: DataFrame, key: str = "id", text: str = "content", share: float = SHARE, least_words: int = WORDS, n: int = GRAM,
            cells: int | None = None, merged: float = MERGED) -> DataFrame:
    """(a, b, share), a < b: representatives whose texts share at least `share` of their word n-grams.

    Lower case, words parted by spaces, tabs, CR and LF. Texts with fewer than `least_words` words, null and empty
    ones take no part; equal texts are one representative, see members().
    """
    reps = stored(representatives(df.where(F.length(text) >= 2 * least_words - 1), key, text).select("id", "text"))
    cells = cells or min(MOST_CELLS, max(LEAST_CELLS, 1 << (CELLS_EACH * reps.count()).bit_length()))
    table = frequencies(reps, least_words, n, cells)
    lists = postings(reps, reps.sparkSession.sparkContext.broadcast(table), share, least_words, n, merged)
    tasks = 8 * (int(table.astype(np.int64).sum() * (1 - share + merged) / POSTINGS) // 8 + 1)
    return verify(cut_lineage(merge(lists, share, merged, tasks)), reps, share, least_words, n)


def enough_words(df: DataFrame, key: str, text: str, least_words: int = WORDS) -> DataFrame:
    """The rows whose text has the words to take part, counted in the JVM."""
    return df.where(F.col(text).isNotNull() & F.col(text).rlike(r"^[ \t\r\n]*(?:[^ \t\r\n]+[ \t\r\n]+){%d}[^ \t\r\n]" % (least_words - 1)))


def pairs(df: DataFrame, key: str = "id", text: str = "content", share: float = SHARE, least_words: int = WORDS) -> DataFrame:
    """(id_a, id_b): the similar pairs of all rows, copies expanded, for a result that is asked for as pairs."""
    found = similar(df, key, text, share, least_words)
    member = cut_lineage(members(enough_words(df, key, text, least_words), key, text))
    across = (found.join(member.select(F.col("rep").alias("a"), F.col("id").alias("x")), "a")
              .join(member.select(F.col("rep").alias("b"), F.col("id").alias("y")), "b").select("x", "y"))
    copies = member.select("rep", F.col("id").alias("x")).join(member.select("rep", F.col("id").alias("y")), "rep").where("x < y").select("x", "y")
    return across.unionByName(copies).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def groups(df: DataFrame, key: str = "id", text: str = "content", share: float = SHARE, least_words: int = WORDS) -> DataFrame:
    """(id, rep, group_id, links): each row with enough words, its representative, the least id of its group, and the
    number of other representatives that its own is similar to. Groups join whatever a chain of links joins."""
    found = cut_lineage(similar(df, key, text, share, least_words).select("a", "b"))
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = components(both)
    links = both.groupBy("a").agg(F.count(F.lit(1)).alias("links"))
    member = members(enough_words(df, key, text, least_words), key, text)
    return (member.join(label.select(F.col("id").alias("rep"), "group_id"), "rep", "left").join(links.select(F.col("a").alias("rep"), "links"), "rep", "left")
            .select("id", "rep", F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links")))


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(id, group_id) of every end of the edges (a, b), given both ways: the least id that links lead to.

    Each round takes the least label among the neighbours and then the label of that label, so that chains shrink
    to half; every round is checkpointed. Labels never leave the executors.
    """
    label = cut_lineage(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")).select(F.col("a").alias("id"), "l"))
    for _ in range(most):
        near = edges.join(label, edges.b == label.id).groupBy("a").agg(F.min("l").alias("m"))
        step = label.join(near, label.id == near.a).select("id", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        jump = step.select(F.col("id").alias("via"), F.col("l").alias("further"))
        new = cut_lineage(step.join(jump, step.l == jump.via, "left").select("id", "old", F.least("l", F.coalesce("further", "l")).alias("l")))
        changed = new.where("old <> l").limit(1).count()
        label = new.select("id", "l")
        if not changed:
            return label.select("id", F.col("l").alias("group_id"))
    raise RuntimeError("components: too many rounds")
