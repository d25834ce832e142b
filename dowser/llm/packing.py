"""Filling fixed-capacity containers with items: bounded-space online best-fit.

Every partition packs its own items as they come: an item goes to the open bin with the least free space that holds
it. A fixed number of bins is open; they lie in a bitset keyed by free space, so the best one is the lowest set bit at
or above the item's size. When one bin too many would be open, the fullest closes; a bin that is full closes at once.
Only items above the capacity are divided: into full bins of their own and a rest, which is packed as any item.

Nothing is shuffled and no partition waits for another; each leaves at most `open_bins` bins partly filled.
A bin's id is partition << 40 | number in the partition; it is the same when a lost task runs again, since the
rows of a file split come in the same order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from dowser.llm.tokenizer import NAME, TOKENIZERS, rank_file, worker_bpe

CAPACITY = 1024
OPEN_BINS = 256


class BestFit:
    """Bins of one partition."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        if capacity < 1 or open_bins < 1:
            raise ValueError("capacity and open_bins are at least 1")
        self.capacity, self.most = capacity, open_bins
        self.free = 0  # bit f: some open bin has f units free
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free space
        self.open = self.made = 0

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def put(self, size: int) -> tuple[int, int]:
        """The bin of an item of 1 to `capacity` units, and the item's offset in it."""
        at = self.free >> size
        if at:
            f = size + (at & -at).bit_length() - 1
            bin_ = self.bins[f].pop()
            if not self.bins[f]:
                self.free ^= 1 << f
            self.open -= 1
        else:
            f, bin_ = self.capacity, self.new()
        rest = f - size
        if rest:
            if self.open == self.most:  # the fullest closes; it may be this one
                least = (self.free & -self.free).bit_length() - 1
                if rest <= least:
                    return bin_, self.capacity - f
                self.bins[least].pop()
                if not self.bins[least]:
                    self.free ^= 1 << least
                self.open -= 1
            self.bins[rest].append(bin_)
            self.free |= 1 << rest
            self.open += 1
        return bin_, self.capacity - f


def packed(sizes, capacity: int, bins: BestFit) -> Iterator[tuple[int, int, int, int, int]]:
    """(item, piece, bin, offset, units) of every piece. Items of no units have one piece, bin -1 and 0 units."""
    for item, size in enumerate(sizes):
        if size <= 0:
            yield item, 0, -1, 0, 0
            continue
        piece = 0
        while size > capacity:
            yield item, piece, bins.new(), 0, capacity
            size -= capacity
            piece += 1
        bin_, offset = bins.put(size)
        yield item, piece, bin_, offset, size


def pack(df: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY,
         open_bins: int = OPEN_BINS, name: str = NAME, folder: str = TOKENIZERS) -> DataFrame:
    """(key, piece, container_id, container_offset, start_token, n_tokens) of every piece of every row.

    A piece holds the tokens start_token to start_token + n_tokens of its row. Null and empty texts have no tokens:
    one row with a null container and n_tokens 0. A key that comes twice is packed twice, as two items.
    """
    ranks = df.sparkSession.sparkContext.broadcast(rank_file(name, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, bins = worker_bpe(ranks), BestFit(capacity, open_bins)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sizes = [bpe.count(t) for t in part.column(1).to_pylist()]
                rows = np.array(list(packed(sizes, capacity, bins)), dtype=np.int64).reshape(-1, 5)
                if not len(rows):
                    continue
                item, piece, bin_, offset, units = rows.T
                none = bin_ < 0
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(item)), pa.array(piece.astype(np.int32)),
                    pa.array(bin_ + base, mask=none), pa.array(offset.astype(np.int32), mask=none),
                    pa.array(piece * capacity), pa.array(units.astype(np.int32)),
                ], names=[key, "piece", "container_id", "container_offset", "start_token", "n_tokens"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, piece int, container_id bigint, container_offset int, start_token bigint, n_tokens int")
