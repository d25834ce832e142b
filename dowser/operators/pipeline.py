"""Chunking and embedding of extracted texts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, OVERLAP, DIM = 1024, 20, 64
Counter = Callable[[str], int]
Embedder = Callable[[Sequence[str]], np.ndarray]

#: From the strongest to the weakest boundary.
_LEVELS = [re.compile(p) for p in (r"\n\s*\n", r"\n", r"(?<=[.!?。！？])\s*", rf"\s+|(?<=[぀-ヿ㐀-䶿一-鿿豈-﫿])", "")]


_IDEOGRAPH = "぀-ヿ㐀-䶿一-鿿豈-﫿"
_TOKEN = re.compile(rf"[{_IDEOGRAPH}]|[^\s{_IDEOGRAPH}]+")
#: A token and the blanks after it.
_SPACED = re.compile(rf"(?:[{_IDEOGRAPH}]|[^\s{_IDEOGRAPH}]+)\s*")


def count_words(text: str) -> int:
    """Words; each character of a script without spaces is one."""
    return sum(1 for _ in _TOKEN.finditer(text))


def _units(text: str, capacity: int, count: Counter, level: int = 0) -> Iterator[str]:
    """Parts of the text, each within the capacity, cut at the strongest boundaries that do; put together they are it."""
    if count(text) <= capacity or level == len(_LEVELS):
        yield text
        return
    at = 0
    cuts = [m.end() for m in _LEVELS[level].finditer(text) if m.end()] if level < len(_LEVELS) - 1 else list(range(1, len(text)))
    for cut in [*cuts, len(text)]:
        if cut > at:
            yield from _units(text[at:cut], capacity, count, level + 1)
            at = cut


def chunks(text: str, capacity: int = CAPACITY, overlap: int = OVERLAP, count: Counter = count_words) -> list[str]:
    """Trimmed chunks of at most `capacity` tokens; each begins with whole parts of the one before, up to `overlap`."""
    if not text.strip():
        return []
    units = [(u, count(u)) for u in _units(text, max(1, capacity - overlap), count)]
    out, now, size = [], [], 0
    for unit, n in units:
        if now and size + n > capacity:
            out.append("".join(u for u, _ in now).strip())
            kept: list[tuple[str, int]] = []
            for word in reversed(_SPACED.findall("".join(u for u, _ in now))):
                w = count(word)
                if sum(k for _, k in kept) + w > overlap or sum(k for _, k in kept) + w + n > capacity:
                    break
                kept.insert(0, (word, w))
            now, size = kept, sum(k for _, k in kept)
        now.append((unit, n))
        size += n
    out.append("".join(u for u, _ in now).strip())
    return [c for c in out if c]


def hashing_embedder(dim: int = DIM) -> Embedder:
    """A deterministic stand-in for a model: signed counts of hashed words. Vectors are not normalised."""

    def embed(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                out[i, h % dim] += 1.0 if h >> 63 else -1.0
        return out

    return embed


def last_token(output: np.ndarray) -> np.ndarray:
    """A model's output as one vector: of [1, sequence, dim] the last token's, [1, dim] and [dim] as they are."""
    if output.ndim == 3 and output.shape[0] == 1:
        return output[0, -1]
    if output.ndim == 2 and output.shape[0] == 1:
        return output[0]
    if output.ndim == 1:
        return output
    raise ValueError(f"unexpected shape {output.shape}")


def chunked(df: DataFrame, key: str = "id", text: str = "content", capacity: int = CAPACITY, overlap: int = OVERLAP, count: Counter = count_words) -> DataFrame:
    """(file_id, chunk_index, chunk_text), index from 0. Null and blank texts have no chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, i, c) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for i, c in enumerate(chunks(t, capacity, overlap, count))]
            if rows:
                k, i, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(i, pa.int64()), pa.array(c, pa.string())], names=["file_id", "chunk_index", "chunk_text"])

    return df.select(F.col(key).cast("bigint").alias(key), text).mapInArrow(run, "file_id bigint, chunk_index bigint, chunk_text string")


def embedded(df: DataFrame, text: str, embedder: Embedder | None = None, batch: int = 64) -> DataFrame:
    """The rows with an `embedding` of the text and an `error`: a failing text has a null vector and says why."""
    embed = embedder or hashing_embedder()
    keep = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                vectors: list = []
                errors: list = []
                texts = [t or "" for t in part.column(keep.index(text)).to_pylist()]
                try:
                    vectors, errors = [v.tolist() for v in embed(texts)], [None] * len(texts)
                except Exception:  # one by one, so that only what fails is lost
                    for t in texts:
                        try:
                            vectors.append(embed([t])[0].tolist())
                            errors.append(None)
                        except Exception as e:
                            vectors.append(None)
                            errors.append(str(e))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], names=[*keep, "embedding", "error"])

    kinds = dict(df.dtypes)
    return df.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "embedding array<float>, error string"]))
