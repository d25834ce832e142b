"""Cells of binary spreadsheets: record streams within compound files (xls, xla), and binary parts within a zip (xlsb)."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator

Rows = list[dict[int, str]]
_END = 0xFFFFFFFC  # greater numbers of sectors are marks


def number(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def rk(v: int) -> float:
    """A number packed into 30 bits: bit 1 says integer, bit 0 hundredths."""
    x = float(v >> 2 if v < 0x80000000 else (v >> 2) - (1 << 30)) if v & 2 else struct.unpack("<d", b"\0\0\0\0" + struct.pack("<I", v & 0xFFFFFFFC))[0]
    return x / 100 if v & 1 else x


def _put(rows: Rows, row: int, column: int, text: str) -> None:
    while len(rows) <= row:
        rows.append({})
    rows[row][column] = text


# --- compound files -----------------------------------------------------------------------------------------------


def compound_stream(data: bytes, names: tuple[str, ...]) -> bytes:
    """The first stream of one of the names."""
    if data[:8] != bytes.fromhex("D0CF11E0A1B11AE1"):
        raise ValueError("no compound file")
    shift, mini_shift = struct.unpack_from("<HH", data, 30)
    size, mini_size = 1 << shift, 1 << mini_shift
    first_dir, = struct.unpack_from("<I", data, 48)
    cutoff, first_mini, _, first_more, _ = struct.unpack_from("<IIIII", data, 56)

    def sector(n: int) -> bytes:
        return data[(n + 1) * size : (n + 2) * size]

    heads = list(struct.unpack_from("<109I", data, 76))
    while first_more < _END:  # further sectors of the table of sectors
        more = struct.unpack(f"<{size // 4}I", sector(first_more))
        heads += more[:-1]
        first_more = more[-1]
    fat = [x for h in heads if h < _END for x in struct.unpack(f"<{size // 4}I", sector(h))]

    def chain(n: int, table: list[int]) -> Iterator[int]:
        for _ in range(len(table)):
            if n >= _END or n >= len(table):
                return
            yield n
            n = table[n]

    whole = lambda n: b"".join(map(sector, chain(n, fat)))
    entries = whole(first_dir)
    found = {}
    for at in range(0, len(entries) - 127, 128):
        length, = struct.unpack_from("<H", entries, at + 64)
        start, total = struct.unpack_from("<II", entries, at + 116)
        found.setdefault(entries[at : at + max(0, length - 2)].decode("utf-16-le", "replace"), (start, total, entries[at + 66]))
    start, total, _ = next(found[n] for n in names if n in found)
    if total >= cutoff:
        return whole(start)[:total]
    root = next(v for v in found.values() if v[2] == 5)
    small = whole(root[0])
    table = list(struct.unpack(f"<{len(m) // 4}I", m)) if (m := whole(first_mini)) else []
    return b"".join(small[n * mini_size : (n + 1) * mini_size] for n in chain(start, table))[:total]


class _Pieces:
    """A record with those that continue it. A string that goes on in the next one says again how it is encoded."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.k, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n and self.k < len(self.parts):
            got = self.parts[self.k][self.at : self.at + n]
            out, n, self.at = out + got, n - len(got), self.at + len(got)
            if n:
                self.k, self.at = self.k + 1, 0
        return out

    def string(self) -> str:
        n, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out, wide = "", flags & 1
        while n and self.k < len(self.parts):
            if self.at >= len(self.parts[self.k]):
                self.k, self.at = self.k + 1, 1
                if self.k >= len(self.parts):
                    break
                wide = self.parts[self.k][0] & 1
            room = min(n, (len(self.parts[self.k]) - self.at) // (1 + wide))
            if not room:
                break
            out += self.take(room * (1 + wide)).decode("utf-16-le" if wide else "latin-1", "replace")
            n -= room
        self.take(4 * runs + extra)
        return out


def xls_sheets(data: bytes) -> list[Rows]:
    stream = compound_stream(data, ("Workbook", "Book"))
    records: list[tuple[int, list[bytes]]] = []
    at = 0
    while at + 4 <= len(stream):
        kind, size = struct.unpack_from("<HH", stream, at)
        body = stream[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0x3C and records:  # continues the one before
            records[-1][1].append(body)
        else:
            records.append((kind, [body]))
    shared: list[str] = []
    sheets: list[Rows] = []
    depth, pending = 0, None
    for kind, parts in records:
        b = parts[0]
        if kind == 0x809:  # begins the globals, a sheet, or a chart within one
            depth += 1
            if depth == 1 and struct.unpack_from("<H", b, 2)[0] == 0x10:
                sheets.append([])
        elif kind == 0x0A:
            depth -= 1
        elif kind == 0xFC:
            pieces = _Pieces(parts)
            _, unique = struct.unpack("<II", pieces.take(8))
            shared = [pieces.string() for _ in range(unique)]
        elif sheets and depth == 1 and len(b) >= 6:
            row, column = struct.unpack_from("<HH", b)
            if kind == 0xFD:
                i, = struct.unpack_from("<I", b, 6)
                _put(sheets[-1], row, column, shared[i] if i < len(shared) else "")
            elif kind == 0x203:
                _put(sheets[-1], row, column, number(struct.unpack_from("<d", b, 6)[0]))
            elif kind == 0x27E:
                _put(sheets[-1], row, column, number(rk(struct.unpack_from("<I", b, 6)[0])))
            elif kind == 0xBD:
                for k in range((len(b) - 6) // 6):
                    _put(sheets[-1], row, column + k, number(rk(struct.unpack_from("<I", b, 6 + 6 * k)[0])))
            elif kind == 0x204:
                _put(sheets[-1], row, column, _Pieces([b[6:], *parts[1:]]).string())
            elif kind == 0x205 and not b[7]:
                _put(sheets[-1], row, column, "true" if b[6] else "false")
            elif kind == 0x06:
                if b[12:14] != b"\xff\xff":
                    _put(sheets[-1], row, column, number(struct.unpack_from("<d", b, 6)[0]))
                elif b[6] == 1:
                    _put(sheets[-1], row, column, "true" if b[8] else "false")
                pending = (row, column) if b[12:14] == b"\xff\xff" and b[6] == 0 else None
        if sheets and kind == 0x207 and pending:  # the text that the formula before gives
            _put(sheets[-1], *pending, _Pieces(parts).string())
            pending = None
    return sheets


# --- binary parts of a zip ----------------------------------------------------------------------------------------


def _records(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(kind, body); kinds take one or two bytes, sizes up to four, seven bits a byte."""
    at = 0
    while at < len(data):
        kind = data[at]
        at += 1
        if kind & 0x80:
            kind = kind & 0x7F | data[at] << 7
            at += 1
        size = shift = 0
        while True:
            c = data[at]
            at += 1
            size |= (c & 0x7F) << shift
            shift += 7
            if not c & 0x80 or shift == 28:
                break
        yield kind, data[at : at + size]
        at += size


def _wide(b: bytes, at: int) -> str:
    n, = struct.unpack_from("<I", b, at)
    return b[at + 4 : at + 4 + 2 * n].decode("utf-16-le", "replace")


def xlsb_sheets(data: bytes) -> list[Rows]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = [_wide(b, 1) for kind, b in _records(z.read("xl/sharedStrings.bin")) if kind == 19] if "xl/sharedStrings.bin" in names else []
        parts = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.bin", n)), key=lambda n: int(re.search(r"\d+", n).group()))
        sheets: list[Rows] = []
        for name in parts:
            rows: Rows = []
            row = 0
            for kind, b in _records(z.read(name)):
                if kind == 0:
                    row, = struct.unpack_from("<I", b)
                elif kind in (2, 4, 5, 6, 7, 8, 9, 10):
                    column, = struct.unpack_from("<I", b)
                    if kind == 7:
                        i, = struct.unpack_from("<I", b, 8)
                        text = shared[i] if i < len(shared) else ""
                    elif kind in (6, 8):
                        text = _wide(b, 8)
                    elif kind in (4, 10):
                        text = "true" if b[8] else "false"
                    else:
                        text = number(rk(struct.unpack_from("<I", b, 8)[0]) if kind == 2 else struct.unpack_from("<d", b, 8)[0])
                    _put(rows, row, column, text)
            sheets.append(rows)
        return sheets
