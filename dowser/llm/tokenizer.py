"""Byte-level BPE encoding with a public tokenizer's rank file.

Each pre-token is encoded by a priority queue of merge ranks over a doubly linked list of symbols: the lowest rank is
merged first, the leftmost of equals; entries whose symbols have changed meanwhile are stale and skipped. Pre-tokens
repeat, so each worker keeps the ids of those it has seen (bounded; a full memo is emptied, which changes no result).

Null and empty texts have an empty list of ids. Strings that look like special tokens are plain text.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

TOKENIZERS = os.environ.get("DOWSER_TOKENIZERS", "/opt/tokenizers")
NAME = "byte_bpe_50k"

#: Fixed value: the pattern that splits text before the merges, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

MEMO = 150_000


def rank_file(name: str = NAME, folder: str = TOKENIZERS) -> bytes:
    """The rank file's bytes, for broadcasting; a vocabulary has a fixed size of about 1 MB."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return f.read()


#: The same alternatives, those that occur most first. No two of them can match at one place but for the last two, and
#: those keep their order, so the result is the same.
_SPLIT = regex.compile(r" ?\p{L}+| ?\p{N}+|'(?:[stmd]|re|ve|ll)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
#: And for ASCII texts, which Python's own engine splits faster.
_SPLIT_ASCII = re.compile(r" ?[A-Za-z]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+").findall


def split(text: str) -> list[str]:
    """The text's pre-tokens, as PATTERN has them."""
    return _SPLIT_ASCII(text) if text.isascii() else _SPLIT(text)


class Pairs(dict):
    """left id << 16 | right id -> the merged id, which is also its rank, or -1; filled as pairs are asked for."""

    def __init__(self, vocabulary: dict[bytes, int], strings: list[bytes]):
        super().__init__()
        self.vocabulary, self.strings = vocabulary, strings

    def __missing__(self, key: int) -> int:
        found = self.vocabulary.get(self.strings[key >> 16] + self.strings[key & 0xFFFF], -1)
        if len(self) >= 1_000_000:
            self.clear()
        self[key] = found
        return found


class ByteBPE(dict):
    """A mapping of pre-tokens to their ids, filled as they are asked for."""

    def __init__(self, ranks: bytes, memo: int = MEMO):
        super().__init__()
        vocabulary = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.vocabulary = vocabulary
        self.strings = [b""] * (max(vocabulary.values()) + 1)
        for s, i in vocabulary.items():
            self.strings[i] = s
        self.byte_ids = [vocabulary[bytes([b])] for b in range(256)]
        self.split = split
        if len(self.strings) > 1 << 16:
            raise ValueError("ids above 16 bits")
        self.pairs = Pairs(vocabulary, self.strings)
        self.memo = memo

    def __missing__(self, token: str) -> tuple[int, ...]:
        ids = tuple(self.merge(token.encode("utf-8", "surrogatepass")))
        if len(self) >= self.memo:
            self.clear()
        self[token] = ids
        return ids

    def merge(self, piece: bytes) -> list[int]:
        whole = self.vocabulary.get(piece)
        if whole is not None:
            return [whole]
        rank, push, pop, byte_ids = self.pairs, heapq.heappush, heapq.heappop, self.byte_ids
        symbols = [byte_ids[b] for b in piece]
        n = len(symbols)
        after = list(range(1, n + 1))  # n: the end
        before = list(range(-1, n))
        # an entry is rank << 32 | place, so equal ranks go from left to right; wanted[place] is the rank that the
        # pair at that place has now, and an entry with another rank is stale
        wanted = [rank[a << 16 | b] for a, b in zip(symbols, symbols[1:], strict=False)]
        wanted.append(-1)
        queue = [r << 32 | i for i, r in enumerate(wanted) if r >= 0]
        heapq.heapify(queue)
        while queue:
            entry = pop(queue)
            i, r = entry & 0xFFFFFFFF, entry >> 32
            if wanted[i] != r:
                continue
            j = after[i]
            symbols[i] = r
            symbols[j] = wanted[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                wanted[i] = s = rank[r << 16 | symbols[k]]
                if s >= 0:
                    push(queue, s << 32 | i)
            else:
                wanted[i] = -1
            h = before[i]
            if h >= 0:
                wanted[h] = s = rank[symbols[h] << 16 | r]
                if s >= 0:
                    push(queue, s << 32 | h)
        return [s for s in symbols if s >= 0]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return list(chain.from_iterable(map(self.__getitem__, self.split(text))))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(len, map(self.__getitem__, self.split(text))))

    def decode(self, ids) -> str:
        """The vocabulary's strings, concatenated."""
        strings = self.strings
        return b"".join([strings[i] for i in ids]).decode("utf-8", "replace")


_loaded: dict[int, ByteBPE] = {}


def worker_bpe(ranks) -> ByteBPE:
    """The worker's encoder, built once from the broadcast rank file."""
    key = hash(ranks.value)
    if key not in _loaded:
        _loaded[key] = ByteBPE(ranks.value)
    return _loaded[key]


def encode(df: DataFrame, text: str = "text", out: str = "ids", keep: tuple[str, ...] = ("doc_id",),
           name: str = NAME, folder: str = TOKENIZERS) -> DataFrame:
    """`keep` and the ids of each row's text. Rows stay in their partitions: nothing is shuffled."""
    ranks = df.sparkSession.sparkContext.broadcast(rank_file(name, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(ranks)
        split, get = bpe.split, bpe.__getitem__
        for batch in batches:
            texts = batch.column(len(keep))
            step = 500
            for at in range(0, batch.num_rows, step):
                offsets, flat = [0], []
                for t in texts.slice(at, step).to_pylist():
                    if t:
                        flat.extend(chain.from_iterable(map(get, split(t))))
                    offsets.append(len(flat))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(at, step) for i in range(len(keep))), lists], names=[*keep, out])

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{out}` array<int>"])
    return df.select(*keep, text).mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", out: str = "text", keep: tuple[str, ...] = ("doc_id",),
           name: str = NAME, folder: str = TOKENIZERS) -> DataFrame:
    """`keep` and the text of each row's ids; null ids give null, no ids the empty text."""
    ranks = df.sparkSession.sparkContext.broadcast(rank_file(name, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(ranks)
        for batch in batches:
            texts = [None if x is None else bpe.decode(x) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string())], names=[*keep, out])

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{out}` string"])
    return df.select(*keep, ids).mapInArrow(run, schema)
