"""Text of files by extension: plain text, word processing, slides, sheets, open documents and PDF.

An extractor takes a file's bytes and the number of characters after which it may stop. Whatever fails, and every
extension without an extractor, gives the empty text.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame

from dowser.functions.exprs import DOCUMENT_EXTS
from dowser.sources.pdf import pdf
from dowser.sources.sheets import xls_sheets, xlsb_sheets

MAX_CHARS = 30_000
Extractor = Callable[[bytes, int], str]


class _Enough(Exception):
    pass


def _parse(xml: bytes, start: Callable[[str, dict], None], text: Callable[[str], None], end: Callable[[str], None] = lambda _: None) -> None:
    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.CharacterDataHandler, parser.EndElementHandler = start, text, end
    try:
        parser.Parse(xml, True)
    except _Enough:
        pass


def plain(data: bytes, most: int = MAX_CHARS) -> str:
    """The first 4 * most bytes as UTF-8, cut to `most` characters. A character cut in half makes it fail, as any
    other invalid byte does."""
    return data[: 4 * most].decode("utf-8")[:most]


@dataclass(frozen=True)
class Markup:
    """How a zipped XML format is read: which members; what its opening tags put before their text; after which
    tags the next text counts (None: all text does); whether texts are trimmed."""

    member: Callable[[str], bool]
    before: dict[str, str]
    reads: frozenset[str] | None = None
    trim: bool = False

    def __call__(self, data: bytes, most: int = MAX_CHARS) -> str:
        out: list[str] = []
        state = {"size": 0, "reading": self.reads is None}

        def start(tag: str, _: dict) -> None:
            if tag in self.before:
                out.append(self.before[tag])
                state["size"] += len(self.before[tag])
            if self.reads is not None and tag in self.reads:
                state["reading"] = True

        def text(s: str) -> None:
            s = s.strip() if self.trim else s
            if s and state["reading"]:
                out.append(s)
                state["size"] += len(s)
                state["reading"] = self.reads is None
                if state["size"] > most > 0:
                    raise _Enough

        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for name in z.namelist():
                if self.member(name) and state["size"] <= most:
                    _parse(z.read(name), start, text)
        return "".join(out)


docx = Markup("word/document.xml".__eq__, {"w:p": "\n\n"}, trim=True)
pptx = Markup(lambda n: n.startswith("ppt/slides") and n.endswith(".xml"), {"a:p": "\n"}, frozenset({"a:p", "a:t"}))
odt = Markup("content.xml".__eq__, {"text:p": "\n\n"}, frozenset({"text:p"}))
odp = Markup("content.xml".__eq__, {"text:p": "\n\n"}, frozenset({"text:p", "text:span"}))


def _cells(rows: list[dict[int, str]]) -> Iterator[str]:
    """Every cell of the used rectangle, row by row."""
    used = [c for r in rows for c in r]
    for r in rows:
        for c in range(min(used), max(used) + 1):
            yield r.get(c, "")


def _joined(sheets: Iterator[list[dict[int, str]]], most: int) -> str:
    out, size = [], 0
    for rows in sheets:
        rows = rows[next((i for i, r in enumerate(rows) if r), len(rows)) :]
        for cell in _cells(rows) if any(rows) else ():
            out.append(cell + "\t")
            size += len(cell) + 1
            if size > most > 0:
                return "".join(out)
    return "".join(out)


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]*", ref).group():
        n = 26 * n + ord(ch) - 64
    return n - 1


def xlsx(data: bytes, most: int = MAX_CHARS) -> str:
    """All sheets; every cell and a tab, without anything between rows."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            def start(tag: str, _: dict) -> None:
                if tag == "si":
                    shared.append("")

            def text(s: str) -> None:
                if shared:
                    shared[-1] += s

            _parse(z.read("xl/sharedStrings.xml"), start, text)

        def sheet(name: str) -> list[dict[int, str]]:
            rows: list[dict[int, str]] = []
            cell = {"at": 0, "kind": "", "in": False}

            def start(tag: str, a: dict) -> None:
                if tag == "row":
                    while a.get("r") and len(rows) < int(a["r"]) - 1:
                        rows.append({})
                    rows.append({})
                elif tag == "c":
                    cell.update(at=_column(a["r"]) if "r" in a else len(rows[-1]), kind=a.get("t", ""))
                cell["in"] = tag in ("v", "t")

            def text(s: str) -> None:
                if cell["in"] and rows:
                    rows[-1][cell["at"]] = shared[int(s)] if cell["kind"] == "s" else {"0": "false", "1": "true"}.get(s, s) if cell["kind"] == "b" else rows[-1].get(cell["at"], "") + s

            def end(tag: str) -> None:
                cell["in"] = False

            _parse(z.read(name), start, text, end)
            return rows

        parts = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n).group()))
        return _joined((sheet(n) for n in parts), most)


def ods(data: bytes, most: int = MAX_CHARS) -> str:
    sheets: list[list[dict[int, str]]] = []
    cell = {"at": 0, "repeat": 1, "text": None}

    def start(tag: str, a: dict) -> None:
        if tag == "table:table":
            sheets.append([])
        elif tag == "table:table-row":
            sheets[-1].append({})
            cell["at"] = 0
        elif tag in ("table:table-cell", "table:covered-table-cell"):
            cell.update(repeat=int(a.get("table:number-columns-repeated", 1)), text="")

    def text(s: str) -> None:
        if cell["text"] is not None:
            cell["text"] += s

    def end(tag: str) -> None:
        if tag in ("table:table-cell", "table:covered-table-cell"):
            if cell["text"]:
                for i in range(cell["repeat"]):
                    sheets[-1][-1][cell["at"] + i] = cell["text"]
            cell["at"] += cell["repeat"]
            cell["text"] = None

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        _parse(z.read("content.xml"), start, text, end)
    return _joined(iter(sheets), most)


def xls(data: bytes, most: int = MAX_CHARS) -> str:
    return _joined(iter(xls_sheets(data)), most)


def xlsb(data: bytes, most: int = MAX_CHARS) -> str:
    return _joined(iter(xlsb_sheets(data)), most)


REGISTRY: dict[str, Extractor] = {e: plain for e in ("txt", "log", "md", "mdx", "ini")} | {"docx": docx, "pptx": pptx, "odt": odt, "odp": odp, "ods": ods, "pdf": pdf, "xls": xls, "xla": xls, "xlsb": xlsb} | {e: xlsx for e in ("xlsx", "xlsm", "xlam")}
assert set(REGISTRY) <= set(DOCUMENT_EXTS)


def text_of(data: bytes | None, ext: str | None, most: int = MAX_CHARS, registry: dict[str, Extractor] = REGISTRY) -> str:
    try:
        return registry[(ext or "").lower()](data or b"", most)
    except Exception:
        return ""


def extracted(df: DataFrame, content: str = "content", ext: str = "file_ext", out: str = "text", most: int = MAX_CHARS, registry: dict[str, Extractor] | None = None) -> DataFrame:
    """The rows with the binary column replaced by its text; `registry` adds or replaces extractors by extension, which
    is also how image, audio and video analysers are plugged in."""
    table = REGISTRY | (registry or {})
    keep = [c for c in df.columns if c != content]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):  # a file at a time: files may be large
                part = batch.slice(row, 1)
                t = text_of(part.column(len(keep))[0].as_py(), part.column(keep.index(ext))[0].as_py(), most, table)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array([t], pa.string())], names=[*keep, out])

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{out}` string"])
    return df.select(*keep, content).mapInArrow(run, schema)
