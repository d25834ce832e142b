"""Splitting oversized texts at natural boundaries by pointer doubling.

A text's boundaries are its word ends, sentence ends, line ends and paragraph ends, and every character where a word
alone is over the limit. Each boundary is joined to its farthest legal successor: the best end within the limit of a
piece that starts `overlap` characters before the boundary. Squaring the successor table again and again gives all cuts
of the greedy split together, in a number of steps that grows as the logarithm of the number of pieces.

Sizes are code points of the normalised text: each run of CR and LF has become one LF, and spaces, tabs, CR and LF are
removed from both ends. A run of several line ends, or of a line of blanks, ends a paragraph.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 4000, 80
#: A piece ends at the strongest boundary in the last part of its room; a weaker one only if there is no stronger.
ROOM = 0.5

_BREAK = re.compile(r"[\r\n]+")
_BLANK_LINE = re.compile(r"\n[ \t]+(?=\n)")
_LINE = re.compile(r"\n")
_SENTENCE = re.compile(r"""[.!?…]+["'”’»)\]]*(?=\s)|[。！？；]+[”’」』）]*""")
_WORD = re.compile(r"\s+")
#: Scripts without spaces: a boundary may follow any of their characters.
_IDEOGRAPH = re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿＀-￯　-〿]")


def normalised(text: Column) -> Column:
    """Runs of CR and LF as one LF, blank ends removed."""
    return F.regexp_replace(F.regexp_replace(text, r"[\r\n]+", "\n"), r"^[ \t\n]+|[ \t\n]+\z", "")


def size(text: Column) -> Column:
    """Code points of the normalised text; null for null."""
    return F.char_length(normalised(text))


def paragraphs(raw: str) -> tuple[str, np.ndarray]:
    """(text, places): a text without blank ends, with each run of CR and LF as one LF, and the places of those LF
    that end a paragraph."""
    out, places, at, size = [], [], 0, 0
    for m in _BREAK.finditer(raw):
        out.append(raw[at : m.start()] + "\n")
        size += len(out[-1])
        if len(m.group().replace("\r\n", "\n")) > 1:
            places.append(size - 1)
        at = m.end()
    text = "".join([*out, raw[at:]])
    places += [m.start() for m in _BLANK_LINE.finditer(text)]
    return text, np.array(places, np.int64)


def boundaries(text: str, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places where a piece may end, ascending, and their strength: 1 word, 2 sentence, 3 line, 4 paragraph. ends: the
    places where paragraphs end."""
    strength = np.zeros(len(text) + 1, np.int8)
    for pattern, level in ((_WORD, 1), (_IDEOGRAPH, 1), (_SENTENCE, 2), (_LINE, 3)):
        after = pattern in (_IDEOGRAPH, _SENTENCE)  # they end with the match, others where it begins
        found = np.fromiter((m.end() if after else m.start() for m in pattern.finditer(text)), np.int64)
        strength[found] = np.maximum(strength[found], level)
    if ends is not None:
        strength[ends] = 4
    strength[len(text)] = 4
    strength[0] = 0
    places = np.flatnonzero(strength)
    return places, strength[places]


def successors(places: np.ndarray, strength: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes (0, the boundaries, and cuts inside overlong words) and each node's farthest legal successor.

    A piece after a cut at c starts at c - overlap (the first at 0) and ends at most `limit` further, beyond c.
    """
    length = int(places[-1])
    # overlong words: where two boundaries lie further apart than a piece may advance, cuts every `limit - overlap`
    step = limit - overlap
    nodes = np.concatenate([[0], places])
    level = np.concatenate([[4], strength])
    gaps = np.flatnonzero(np.diff(nodes) > step)
    if len(gaps):
        extra = np.concatenate([np.arange(nodes[g] + step, nodes[g + 1], step) for g in gaps])
        level = np.concatenate([level, np.zeros(len(extra), level.dtype)])
        nodes = np.concatenate([nodes, extra])
        order = np.argsort(nodes, kind="stable")
        nodes, level = nodes[order], level[order]
    start = np.where(nodes > 0, np.maximum(nodes - overlap, 0), 0)
    reach = np.minimum(start + limit, length)
    far = np.searchsorted(nodes, reach, "right") - 1  # the last node within reach
    least = np.maximum(nodes + 1, start + int(limit * ROOM))
    best = np.zeros(len(nodes), np.int64)
    found = far == len(nodes) - 1  # what is left fits
    best[found] = far[found]
    for want in (4, 3, 2, 1, 0):
        at = np.flatnonzero(level >= want)
        k = np.searchsorted(at, far, "right") - 1  # the last node of that strength within reach
        k = at[np.maximum(k, 0)]
        ok = ~found & (nodes[k] >= least)
        best[ok] = k[ok]
        found |= ok
    # nothing in the last part of the room: any boundary beyond the cut
    best[~found] = np.maximum(far[~found], np.flatnonzero(~found) + 1)
    best[-1] = len(nodes) - 1
    return nodes, best


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP, ends: np.ndarray | None = None) -> np.ndarray:
    """The places of all cuts, from 0 to the end, by squaring the successor table."""
    nodes, jump = successors(*boundaries(text, ends), limit, overlap)
    end = len(nodes) - 1
    path = np.array([0])
    while path[-1] != end:  # path holds the first 2^k cuts, jump leads 2^k cuts on
        path = np.concatenate([path, jump[path]])
        jump = jump[jump]
    path = path[: np.argmax(path == end) + 1]
    return nodes[path]


def pieces(raw: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[str]:
    """The pieces of a text; each but the first begins with the last `overlap` characters of the one before."""
    text, ends = paragraphs(raw.strip(" \t\r\n"))
    if len(text) <= limit:
        return [text]
    at = cuts(text, limit, overlap, ends)
    return [text[max(0, a - overlap) if i else 0 : b] for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))]


def split(df: DataFrame, text: str, key: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_index, chunk_start, chunk_text) of the pieces of every row whose text is above the limit.

    Null, empty and blank texts and those within the limit have no rows. A key that comes twice is split twice.
    The test of size runs in the JVM, so only oversized texts reach Python.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap is below the limit")
    kind = dict(df.dtypes)[key]
    # a text cannot shrink to fit if it has few code points to begin with: the cheap test comes first
    big = df.where((F.char_length(text) > limit) & (size(F.col(text)) > limit)).select(key, F.regexp_replace(F.col(text), r"^[ \t\r\n]+|[ \t\r\n]+\z", "").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                t, ends = paragraphs(batch.column(1)[row].as_py())
                at = cuts(t, limit, overlap, ends)
                begin = np.maximum(at[:-1] - overlap, 0)
                begin[0] = 0
                n = len(begin)
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch.column(0)[row].as_py()] * n, batch.schema.field(0).type), pa.array(np.arange(n)), pa.array(begin),
                    pa.array([t[a:b] for a, b in zip(begin.tolist(), at[1:].tolist(), strict=True)], pa.string()),
                ], names=[key, "chunk_index", "chunk_start", "chunk_text"])

    return big.mapInArrow(run, f"`{key}` {kind}, chunk_index bigint, chunk_start bigint, chunk_text string")
