import hashlib
import io
import struct
import zipfile
import zlib
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dowser import schemas as S
from dowser.api import Engine, Setting
from dowser.functions import exprs as X
from dowser.operators import pipeline, references, relational, search
from dowser.sources import extract, pdf
from dowser.store import Change, ConcurrentChangeError
from dowser.streaming import events as EV

T0 = datetime(2024, 1, 1)


def at(hours):
    return T0 + timedelta(hours=hours)


def refs(spark, rows):
    return spark.createDataFrame([("a", i, f, at(h)) for i, f, h in rows], references.REFS)


def parents(spark, rows):
    return spark.createDataFrame([(i, at(h), None) for i, h in rows], references.PARENTS)


def found(df):
    return sorted((r.row_id, r.resolved_at and int((r.resolved_at - T0).total_seconds() // 3600)) for r in df.collect())


def test_orphans_step_by_step(spark):
    s = references.OrphanState.empty(spark)
    s = s.advance(refs(spark, [(1, 10, 1), (2, 11, 1), (3, 12, 1), (3, 12, 1)]), parents(spark, [(10, 0)]))
    assert found(s.pending) == [(2, None), (3, None)] == found(s.opened)
    s = s.advance(None, parents(spark, [(11, 5), (12, 0)]))  # 11 came later; 12 was only delivered late
    assert found(s.pending) == [(2, 5)]
    s = s.advance(None, None, spark.createDataFrame([(10, at(6))], "id bigint, gone timestamp_ntz"))
    assert found(s.pending) == [(1, None), (2, 5)]
    s = s.advance(refs(spark, [(1, 10, 1), (4, 10, 7)]), None)  # seen before; and to a deleted parent
    assert found(s.pending) == [(1, None), (2, 5), (4, None)] and found(s.opened) == [(4, None)]
    assert [(r.src_table, r.orphans, r.waiting) for r in s.snapshot().collect()] == [("a", 3, 2)]


@pytest.mark.parametrize("seed", range(2))
def test_orphans_in_batches_as_at_once(spark, seed):
    rng = np.random.default_rng(seed)
    r = [(i, int(rng.integers(0, 20)), int(rng.integers(0, 50))) for i in range(60)]
    p = [(i, int(rng.integers(0, 50))) for i in range(0, 20, 2)]
    s = references.OrphanState.empty(spark)
    for k in range(3):
        s = s.advance(refs(spark, r[20 * k : 20 * k + 20]), parents(spark, p[k::3]))
    at_once = references.OrphanState.empty(spark).advance(refs(spark, r), parents(spark, p)).pending
    assert found(s.pending) == found(at_once) == found(references.OrphanState.load(spark, s.folder).pending)
    replayed = references.replay(references.OrphanState.empty(spark, buckets=3), refs(spark, r), parents(spark, p), batches=4)
    assert found(replayed.pending) == found(at_once)
    since = dict(p)
    assert [i for i, _ in found(at_once)] == sorted(i for i, f, h in r if f not in since or since[f] > h)


@pytest.mark.parametrize("with_deletion", [True, False])
def test_orphans_delivered_after_the_deletion(spark, with_deletion):
    gone = spark.createDataFrame([(10, at(6))], "id bigint, gone timestamp_ntz")
    late = refs(spark, [(1, 10, 5), (2, 10, 9)])
    s = references.OrphanState.empty(spark).advance(None, parents(spark, [(10, 1)]))
    s = s.advance(late, None, gone) if with_deletion else s.advance(None, None, gone).advance(late)
    assert found(s.pending) == [(1, None), (2, None)] == found(s.opened)
    s = s.advance(refs(spark, [(3, 10, 9)]), parents(spark, [(10, 8)]))  # created again
    assert found(s.pending) == [(1, 8)] and found(s.opened) == []


@pytest.mark.parametrize("seed", range(2))
def test_orphans_with_deletions_in_any_order(spark, seed):
    rng = np.random.default_rng(seed)
    r = [(i, int(rng.integers(0, 8)), int(rng.integers(0, 50))) for i in range(40)]
    p = [(i % 7, int(rng.integers(0, 50))) for i in range(14)]  # each comes twice
    d = [(i, int(rng.integers(0, 50))) for i in (0, 1, 2, 3, 3)]
    want = []
    for i, f, h in r:
        gone = max((g for q, g in d if q == f), default=-1)
        start = min((c for q, c in p if q == f and c > gone), default=None)
        if start is None or start > h:
            want.append((i, start))
    s = references.OrphanState.empty(spark)
    kinds = [("r", x) for x in r] + [("p", x) for x in p] + [("d", x) for x in d]
    parts = np.array_split(rng.permutation(len(kinds)), 3)
    for part in parts:
        of = {k: [kinds[x][1] for x in part if kinds[x][0] == k] for k in "rpd"}
        s = s.advance(refs(spark, of["r"]), parents(spark, of["p"]), spark.createDataFrame([(i, at(h)) for i, h in of["d"]], "id bigint, gone timestamp_ntz"))
    assert found(s.pending) == sorted(want)


def test_orphans_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, at(1), 0), (2, 5, None, 0), (2, 5, None, 0), (None, 5, at(1), 0)], "id bigint, file_id bigint, create_time timestamp_ntz, since int")
    state = references.OrphanState.empty(spark)
    got = references.replay(state, references.references(df, "t"), parents(spark, [(5, 0)])).pending
    assert [(r.src_table, r.row_id) for r in got.collect()] == [("t", 2)]
    empty = references.replay(state, references.references(df.limit(0), "t"), references.parents(df.limit(0)))
    assert empty.pending.collect() == [] == empty.snapshot().collect()


def test_orphan_state_is_appended_and_put_together(spark, monkeypatch):
    s, folder = references.OrphanState.empty(spark, buckets=1), None
    monkeypatch.setattr(references, "MERGE", 3)
    for k in range(references.MERGE + 2):
        s = s.advance(refs(spark, [(k, k % 3, k)]), parents(spark, [(k % 3, 40 + k)]))
        folder = s.folder
    assert max(len(f) for w in (s.where["refs"], s.where["parents"]) for f in w.values()) <= references.MERGE + 1
    assert found(s.pending) == [(k, 40 + k % 3) for k in range(references.MERGE + 2)]
    half = references.Folder(spark, folder).at(f"v{s.version + 1}")  # a batch that was lost midway does not count
    half.write("anything", "x")
    assert references.OrphanState.load(spark, folder).version == s.version


def one(spark, column, **row):
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row)).select(column.alias("x")).first().x


@pytest.mark.parametrize(("path", "name", "ext", "kind"), [
    ("/a/b.TXT", "b.TXT", "txt", "file"), ("C:\\x\\y.tar.gz", "y.tar.gz", "gz", "file"), ("/a/.env", ".env", "", "file"), ("/a/b/", "b", "", "directory"),
    ("", "", "", "directory"), ("plain", "plain", "", "directory"), ("/a/..", "..", "", "directory"), ("/a/b.", "b.", "", "directory")])
def test_paths(spark, path, name, ext, kind):
    assert one(spark, X.file_name("p"), p=path) == name
    assert one(spark, X.file_ext("p"), p=path) == ext
    assert one(spark, X.path_kind("p"), p=path) == kind


@pytest.mark.parametrize(("query", "intent"), [("a/b c d", "path"), ("two words", "path"), ("x y z", "hybrid"), ("tell me about it", "hybrid"), ("one two three four five", "semantic"),
                                               ("  日本 語 の文 書です ", "semantic"), ("", "path")])
def test_intent(spark, query, intent):
    assert one(spark, X.search_intent("q"), q=query) == intent


def test_encryption_as_by_another_program(spark):
    # openssl enc -aes-128-cbc, key 0123456789abcdef, vector fedcba9876543210
    known = "6C8611A23E891A9FD3669048B22696CDF40051198086F3161ED2510EE7BE78A3"
    assert one(spark, F.hex(X.encrypt("p", "0123456789abcdef", "fedcba9876543210")), p="Quarterly report.docx") == known
    assert one(spark, X.decrypt(F.unhex("p"), "0123456789abcdef", "fedcba9876543210"), p=known) == "Quarterly report.docx"


def test_chunks_of_a_script_without_spaces():
    got = pipeline.chunks("今天我们看了那份报告。" * 3000)
    assert len(got) > 20 and all(pipeline.count_words(c) <= pipeline.CAPACITY for c in got) and got[0][-5:] == got[1][:20][-5:]


def leftmost_longest(text, words):
    low, n, i = text.lower(), 0, 0
    while i < len(low):
        hit = max((len(w) for w in words if low.startswith(w.lower(), i)), default=0)
        n, i = n + (hit > 0), i + (hit or 1)
    return n


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("abAB.", min_size=1, max_size=4), min_size=1, max_size=4), st.text("abAB./c", max_size=20))
def test_path_search_matches_brute_force(spark, words, path):
    cache = spark.createDataFrame([(0, 1, path)], "line_num bigint, file_id bigint, path string")
    got = search.path_search(cache, " ".join(words)).collect()
    want = leftmost_longest(path, words)
    assert [r.score for r in got] == ([want] if want else [])


def test_knn_ties_duplicates_and_bad_vectors(spark):
    rows = [(i, 1, v) for i, v in [(5, [1.0, 0.0]), (3, [2.0, 0.0]), (3, [2.0, 0.0]), (4, None), (6, []), (7, [0.0, 0.0]), (8, [1.0]), (9, [None, 1.0]), (2, [0.0, 1.0])]]
    df = spark.createDataFrame(rows, "id bigint, file_id bigint, embedding array<float>")
    assert [(r.id, r.distance) for r in search.knn(df, [1.0, 0.0], 3, -1).collect()] == [(3, 0.0), (5, 0.0), (2, 1.0)]
    assert [r.id for r in search.knn(df, [1.0, 0.0], 3, 0.5).collect()] == [3, 5]
    assert search.knn(df.limit(0), [1.0, 0.0]).collect() == []
    long = spark.createDataFrame([(1, 1, [1.0] * 200)], df.schema)
    assert search.knn(long, [1.0] * 200).first().distance == 0.0


def test_removals_and_renames(spark):
    f = spark.createDataFrame([(1, "/a/x.txt", "x.txt"), (2, "/a/b/y.txt", "y.txt"), (3, "/ab/z.txt", "z.txt"), (4, "/c/a/w.txt", "w.txt"), (5, None, None)], "id bigint, path string, name string")
    e = spark.createDataFrame([(10, 1), (11, 2), (12, 3), (13, None)], "id bigint, file_id bigint")
    gone = spark.createDataFrame([("/a", False), ("/ab/z.txt", True), ("/none", None)], "path string, is_file boolean")
    left = relational.apply_removals(f, e, e, gone)
    assert [sorted(r[0] for r in t.collect()) for t in left] == [[4, 5], [13], [13]]
    to = spark.createDataFrame([("/a", "/new"), ("/a/b", "/deep"), ("/ab/z.txt", "/ab/q.txt"), ("/c/a/w.txt", None)], "path string, to_path string")
    got = {r.id: (r.path, r.name) for r in relational.apply_renames(f, to).collect()}
    assert got == {1: ("/new/x.txt", "x.txt"), 2: ("/deep/y.txt", "y.txt"), 3: ("/ab/q.txt", "q.txt"), 4: ("/c/a/w.txt", "w.txt"), 5: (None, None)}


def test_like_prefix_wildcards_and_case(spark):
    df = spark.createDataFrame([("/A_b/x",), ("/aXb/x",), ("/É/x",), ("C:\\d\\x",)], "path string")
    assert {r.path for r in df.where(X.under_directory("path", "/a_b")).collect()} == {"/A_b/x", "/aXb/x"}
    assert [r.path for r in df.where(X.under_directory("path", "c:\\d", "\\")).collect()] == ["C:\\d\\x"]
    assert df.where(X.under_directory("path", "/é")).collect() == []


def test_overlay_and_upsert(spark):
    files = spark.createDataFrame([(1, "/a.txt", at(1), 3), (2, "/b.txt", at(1), 3), (3, "/c.txt", at(1), 1)], "id bigint, path string, file_update_time timestamp_ntz, content_index_status int")
    scan = spark.createDataFrame([("/a.txt", at(1)), ("/b.txt", at(2)), ("/c.txt", at(0)), ("/d.txt", at(0)), ("/d.txt", at(0))], "path string, modified timestamp_ntz")
    assert {r.path: r.action for r in relational.upsert_plan(scan, files).collect()} == {"/a.txt": "skip", "/b.txt": "update", "/c.txt": "update", "/d.txt": "new"}
    got = {r.path: (r.id, r.content_index_status) for r in relational.apply_upsert(scan, files).collect()}
    assert got["/a.txt"] == (1, 3) and got["/b.txt"] == (2, 1) and got["/d.txt"][1] == 1 and len(got) == 4
    assert {r.path: r.content_index_status for r in relational.apply_upsert(scan, files, requeue=False).collect()}["/b.txt"] == 3
    with pytest.raises(KeyError):
        relational.require(files, "id", 99)
    with pytest.raises(ValueError):
        relational.sorted_page(files, "id; drop", True, 1, 1, ["id"])


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def test_extractors():
    docx = zipped(**{"word__document.xml": '<w:d xmlns:w="w"><w:p><w:r><w:t> One </w:t></w:r></w:p><w:p><w:t>two</w:t></w:p></w:d>'})
    assert extract.text_of(docx, "DOCX") == "\n\nOne\n\ntwo"
    assert extract.docx(docx, 1) == "\n\nOne"
    pptx = zipped(**{"ppt__slides__slide1.xml": '<p xmlns:a="a"><a:p><a:t>A</a:t><a:t>B</a:t></a:p></p>', "ppt__notes.xml": "<x/>"})
    assert extract.text_of(pptx, "pptx") == "\nAB"
    odt = zipped(**{"content.xml": '<o xmlns:text="t"><text:p>First<text:span>not</text:span>rest</text:p><text:p>Next</text:p></o>'})
    assert extract.text_of(odt, "odt") == "\n\nFirst\n\nNext" and extract.text_of(odt, "odp") == "\n\nFirstnot\n\nNext"
    xlsx = zipped(**{"xl__sharedStrings.xml": "<sst><si><t>name</t></si></sst>", "xl__worksheets__sheet1.xml":
                     '<s><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="D2"><v>7</v></c></row><row r="3"><c r="C3" t="b"><v>1</v></c></row></sheetData></s>'})
    assert extract.text_of(xlsx, "xlsx") == "name\t\t7\t\ttrue\t\t"
    ods = zipped(**{"content.xml": '<o xmlns:table="t" xmlns:text="x"><table:table><table:table-row><table:table-cell><text:p>a</text:p></table:table-cell><table:table-cell table:number-columns-repeated="2"><text:p>b</text:p></table:table-cell></table:table-row></table:table></o>'})
    assert extract.text_of(ods, "ods") == "a\tb\tb\t"
    pdf = b"%PDF\n1 0 obj <</Length 44>> stream\nBT /F1 24 Tf (Hello \\(PDF\\)  ) Tj T* [(Wor) -20 (ld)] TJ ET\nendstream endobj"
    assert extract.text_of(pdf, "pdf") == "Hello (PDF)World"
    assert extract.text_of("héllo".encode(), "txt", 2) == "hé"
    assert extract.text_of(b"\xff\xfe", "txt") == extract.text_of(b"junk", "docx") == extract.text_of(b"x", "exe") == extract.text_of(None, None) == ""


def test_pdf_pages_fonts_object_streams_and_encryption():
    cmap = b"1 beginbfchar <0001> <0041> endbfchar 1 beginbfrange <0002> <0004> <4E00> endbfrange 1 beginbfrange <0005> <0006> [<0062> <00630064>] endbfrange"
    pages = [b"<< /Type /Page /Contents 6 0 R >> ", b"<< /Type /Page /Contents [5 0 R] /Resources << /Font << /F1 8 0 R >> >> >>"]
    head = b"4 0 7 %d " % len(pages[0])
    first, packed = len(head), head + b"".join(pages)
    body = zlib.compress(packed)

    def stream(number, head, data):
        return b"%d 0 obj << %s /Length %d >> stream\n%s\nendstream endobj\n" % (number, head, len(data), data)

    parts = [b"%PDF-1.5\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [7 0 R 4 0 R] /Count 2 >> endobj\n",
             stream(3, b"/Type /ObjStm /N 2 /First %d /Filter /FlateDecode" % first, body), stream(6, b"", b"BT (last ) Tj ET"),
             stream(5, b"/Filter /FlateDecode", zlib.compress(b"BT /F1 9 Tf <00010002> Tj T* [<0004> -20 <00050006>] TJ ET")), b"8 0 obj << /Type /Font /ToUnicode 9 0 R >> endobj\n", stream(9, b"", cmap)]
    assert pdf.pdf(b"".join(parts) + b"trailer << /Root 1 0 R >>") == "A一丂bcdlast"  # page 7 comes before page 4
    owner, ident = b"\x07" * 32, b"id"
    key = hashlib.md5(pdf._PAD + owner + (0xFFFFFFFC).to_bytes(4, "little") + ident).digest()[:5]
    own = hashlib.md5(key + (6).to_bytes(3, "little") + b"\0\0").digest()[:10]
    locked = b"%PDF\n1 0 obj << /Pages 2 0 R >> endobj 2 0 obj << /Kids [4 0 R] >> endobj 4 0 obj << /Contents 6 0 R >> endobj " + stream(6, b"", pdf._rc4(own, b"BT (secret) Tj ET"))
    assert pdf.pdf(locked + b"trailer << /Root 1 0 R /ID [<6964> <6964>] /Encrypt << /V 1 /R 2 /P -4 /O <" + owner.hex().encode() + b"> >> >>") == "secret"
    assert pdf._rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    assert extract.text_of(locked + b"trailer << /Root 1 0 R /Encrypt << /V 5 >> >>", "pdf") == "" and pdf.pdf(b"") == ""


def compound(stream):
    """A compound file with one stream: large ones in sectors of their own, small ones in the root's."""
    small = len(stream) < 4096
    body = stream.ljust(-(-len(stream) // 512) * 512, b"\0")
    n = len(body) // 512
    fat = [0xFFFFFFFD, 0xFFFFFFFE] + [k + 3 for k in range(n - 1)] + [0xFFFFFFFE]
    mini = b""
    if small:
        count = -(-len(stream) // 64)
        mini = struct.pack("<128I", *[*range(1, count), 0xFFFFFFFE, *[0xFFFFFFFF] * (128 - count)])
        fat.append(0xFFFFFFFE)

    def entry(name, kind, start, size):
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + struct.pack("<III", *[0xFFFFFFFF] * 3) + b"\0" * 36 + struct.pack("<IQ", start, size)

    folder = entry("Root Entry", 5, 2 if small else 0xFFFFFFFE, len(body) if small else 0) + entry("Workbook", 2, 0 if small else 2, len(stream)) + b"\0" * 256
    head = bytes.fromhex("D0CF11E0A1B11AE1") + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIII", 0, 1, 1, 0, 4096)
    head += struct.pack("<IIII", 2 + n if small else 0xFFFFFFFE, int(small), 0xFFFFFFFE, 0) + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    return head + struct.pack("<128I", *fat, *[0xFFFFFFFF] * (128 - len(fat))) + folder + body + mini


@pytest.mark.parametrize("large", [False, True])
def test_binary_sheets(large):
    rec = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    text = lambda t: struct.pack("<HB", len(t), 1) + t.encode("utf-16-le")
    # the second string is cut by a record that continues it, in which it is encoded otherwise
    sst = rec(0xFC, struct.pack("<II", 2, 2) + text("名前") + struct.pack("<HB", 6, 1) + "abc".encode("utf-16-le")) + rec(0x3C, b"\0def")
    cell = lambda kind, column, body: rec(kind, struct.pack("<HHH", 1, column, 0) + body)
    sheet = rec(0x809, struct.pack("<HH", 0x600, 0x10)) + cell(0xFD, 1, struct.pack("<I", 0)) + cell(0xFD, 2, struct.pack("<I", 1)) + cell(0x203, 3, struct.pack("<d", 2.5)) + cell(0x27E, 4, struct.pack("<I", 7 << 2 | 2))
    sheet += cell(0x205, 5, b"\1\0") + cell(0x06, 6, b"\0" * 6 + b"\xff\xff" + b"\0" * 6) + rec(0x207, text("sum")) + rec(0xBD, struct.pack("<HHHIHIH", 2, 1, 0, 150 << 2 | 3, 0, (-3 & 0x3FFFFFFF) << 2 | 2, 2)) + rec(0x0A, b"")
    stream = rec(0x809, struct.pack("<HH", 0x600, 5)) + sst + rec(0x0A, b"") + sheet + (rec(0x5555, b"\0" * 5000) if large else b"")
    want = "名前\tabcdef\t2.5\t7\ttrue\tsum\t1.5\t-3\t\t\t\t\t"
    assert extract.text_of(compound(stream), "xls") == want == extract.text_of(compound(stream), "XLA")
    brt = lambda kind, body: bytes([kind, len(body)]) + body
    wide = lambda t: struct.pack("<I", len(t)) + t.encode("utf-16-le")
    at = lambda column, body: struct.pack("<II", column, 0) + body
    rows = brt(0, struct.pack("<I", 3)) + brt(7, at(0, struct.pack("<I", 0))) + brt(2, at(1, struct.pack("<I", 7 << 2 | 2))) + brt(5, at(2, struct.pack("<d", 0.25))) + brt(4, at(3, b"\0")) + brt(6, at(4, wide("x")))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.bin", bytes([0x9F, 1, 0]) + brt(19, b"\0" + wide("名")))
        z.writestr("xl/worksheets/sheet1.bin", rows)
    assert extract.text_of(out.getvalue(), "xlsb") == "名\t7\t0.25\tfalse\tx\t"
    assert extract.text_of(b"junk", "xls") == extract.text_of(b"junk", "xlsb") == ""


@settings(max_examples=60, deadline=None)
@given(st.text("ab \n.", max_size=300), st.integers(1, 12), st.integers(0, 3))
def test_chunks(text, capacity, overlap):
    got = pipeline.chunks(text, capacity + overlap, overlap)
    assert all(0 < len(c.split()) <= capacity + overlap for c in got)
    assert (not text.strip()) == (not got)
    if overlap == 0:
        assert " ".join(got).split() == text.split() or "".join(got).replace(" ", "").replace("\n", "") == text.replace(" ", "").replace("\n", "")


def test_last_token():
    x = np.arange(6).reshape(1, 2, 3)
    assert pipeline.last_token(x).tolist() == [3, 4, 5] == pipeline.last_token(x[:, 1]).tolist() == pipeline.last_token(x[0, 1]).tolist()
    with pytest.raises(ValueError):
        pipeline.last_token(np.zeros((2, 2)))


EVENTS = "event_id bigint, ts timestamp_ntz, kind string, path string, to_path string, is_file boolean"


def events(spark, rows):
    return spark.createDataFrame([(i, T0 + timedelta(seconds=s), k, p, None, None) for i, (s, k, p) in enumerate(rows)], EVENTS)


def test_sessions_are_global(spark):
    df = events(spark, [(0, "modify", "/a"), (0.9, "create", "/b"), (1.8, "remove", "/a"), (2.8, "create", "/a"), (3.0, "other", "/c"), (7200, "modify", "/a")])
    got = {(int((r.session_start - T0).total_seconds()), r.path, r.kind, r.events) for r in EV.sessions(df).collect()}
    assert got == {(0, "/a", "remove", 2), (0, "/b", "create", 1), (2, "/a", "create", 1), (7200, "/a", "modify", 1)}
    assert EV.sessions(df.limit(0)).collect() == []


def test_thinned_events_make_the_same_sessions(spark):
    rng = np.random.default_rng(5)
    t, rows = 0.0, []
    for i in range(3000):
        t += float(rng.choice([0.001, 0.2, 0.999, 1.0, 1.5], p=[0.6, 0.2, 0.15, 0.03, 0.02]))
        rows.append((t, str(rng.choice(["create", "modify", "remove", "other"])), f"/p{int(rng.integers(5))}"))
    df = events(spark, rows).drop("arrive_time").select("event_id", "ts", "kind", "path", "to_path", "is_file")
    mine = lambda d: sorted((r.session_start, r.path, r.kind, r.event_id) for r in EV.sessions(d).collect())
    old, new = df.where("event_id < 1500"), df.where("event_id >= 1500")
    assert mine(EV.thinned(old).unionByName(new)) == mine(df)
    # steady traffic: what is kept goes with the seconds and the paths, not with the events
    steady = spark.range(100_000).select(F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id / 5000.0)").alias("ts"), F.lit("modify").alias("kind"),
                                         F.concat(F.lit("/p"), (F.col("id") % 7).cast("string")).alias("path"), F.lit(None).cast("string").alias("to_path"), F.lit(True).alias("is_file"))
    assert EV.thinned(steady).count() <= 2 * 21 + 7 and EV.sessions(EV.thinned(steady)).count() == 7


def test_rename_pairing():
    rows = [(0, "rename_from", "/a"), (0.1, "rename_from", "/b"), (0.2, "rename_to", "/x"), (0.25, "rename_to", "/y"), (0.3, "rename_to", "/z"), (1, "rename_from", "/q"), (2, "modify", "/m"), (3, "rename_from", "/w")]
    df = pd.DataFrame([(i, T0 + timedelta(seconds=s), k, p, None) for i, (s, k, p) in enumerate(rows)], columns=["event_id", "ts", "kind", "path", "to_path"])
    out, waiting = EV.pair_renames(df)
    assert [(r.kind, r.path, r.to_path) for r in out.itertuples()] == [("rename", "/a", "/x"), ("rename", "/b", "/y"), ("create", "/z", None), ("remove", "/q", None), ("modify", "/m", None)]
    assert [p for _, p, _ in waiting] == ["/w"]


def test_rename_pairing_in_stretches(spark):
    rng = np.random.default_rng(3)
    rows, t = [], 0.0
    for i in range(400):
        t += float(rng.choice([0.0, 0.05, 0.2, 0.3, 0.31, 5, 4000], p=[0.1, 0.3, 0.3, 0.1, 0.1, 0.08, 0.02]))
        rows.append((i, T0 + timedelta(seconds=round(t, 3)), str(rng.choice(["rename_from", "rename_to", "modify"])), f"/p{i}", None))
    pdf = pd.DataFrame(rows, columns=["event_id", "ts", "kind", "path", "to_path"])
    out, waiting = EV.pair_renames(pdf)
    want = sorted([(r.kind, r.path, r.to_path) for r in out.itertuples()] + [("remove", p, None) for _, p, _ in waiting], key=str)
    df = spark.createDataFrame(rows, EV.PAIRED).withColumn("source", F.lit("root"))
    assert sorted(((r.kind, r.path, r.to_path) for r in EV.paired(df, "source").collect()), key=str) == want
    assert EV.paired(df.limit(0), "source").collect() == []


def test_engine_end_to_end(spark, tmp_path):
    root = tmp_path / "docs"
    (root / ".hidden").mkdir(parents=True)
    (root / "notes.txt").write_text("the quarterly budget meeting\r\n\r\nwas moved to friday")
    (root / "plan.md").write_text("garden plan with roses")
    (root / "empty.txt").write_text("")
    (root / "photo.png").write_bytes(b"\x89PNG")
    (root / ".hidden" / "x.txt").write_text("no")
    (root / "skip.bin").write_bytes(b"0")
    steps = []
    e = Engine(spark, str(tmp_path / "index"), buckets=2, on_progress=lambda step, known: steps.append(step))
    task = e.index([str(root), str(tmp_path / "missing")], ignore_exts=["bin"])
    assert (task.status, task.total_cnt, task.content_indexed_success_cnt, task.content_indexed_skipped_cnt) == ("completed", 4, 3, 1)
    assert steps == ["start", "scan", "extract", "embed", "finish"]
    assert {r.name: r.content_index_status for r in e.files().collect()} == {"notes.txt": 3, "plan.md": 3, "empty.txt": 3, "photo.png": 1}
    assert e.counts().asDict() == {"total": 4, "waiting": 1, "indexing": 0, "indexed": 3, "failed": 0}
    assert e.semantic_search("the quarterly budget meeting was moved to friday", most=-1).first().path.endswith("notes.txt")
    assert [r.path.rsplit("/", 1)[1] for r in e.path_search("PLAN").collect()] == ["plan.md"]
    assert e.ask("/plan").count() == 1 and e.ask("x").count() == 0 and e.search("plan").count() == 1
    assert [r.path for r in e.paths(1, 2, False).collect()] == [r.path for r in e.paths(1, 9).collect()][::-1][:2]
    note = e.store.read("file_info").where("name = 'notes.txt'").first()
    assert note.content == "the quarterly budget meeting\nwas moved to friday" and e.file(note.id).name == "notes.txt" and e.file(0) is None
    assert e.data(note.path) == (root / "notes.txt").read_bytes() and e.data(str(root / "none.txt")) is None
    assert e.path_type(note.path) == "file" and e.path_type(str(root)) == "directory"
    with pytest.raises(FileNotFoundError):
        e.path_type(str(root / "none"))
    assert e.stored_metadata(note.path).category == S.DOCUMENT
    # the path is in the index's cache: new files join it, vanished ones leave; nothing else is done again
    (root / "new plan.txt").write_text("later")
    (root / "empty.txt").unlink()
    steps.clear()
    again = e.index([str(root)], ignore_exts=["bin"])
    assert again.total_cnt == 4 and e.tasks().count() == 2 and not e.model_changed()
    assert {r.name for r in e.files().collect()} == {"notes.txt", "plan.md", "new plan.txt", "photo.png"}
    assert {r.path.rsplit("/", 1)[1] for r in e.path_search("PLAN").collect()} == {"plan.md", "new plan.txt"} and e.path_search("empty").count() == 0
    e.apply_events(spark.createDataFrame([(str(root / "plan.md"), "rename", str(root / "plant.md"), True), (str(root / "notes.txt"), "remove", None, True)], "path string, kind string, to_path string, is_file boolean"))
    assert {r.name for r in e.files().collect()} == {"plant.md", "new plan.txt", "photo.png"}
    assert {r.path.rsplit("/", 1)[1] for r in e.path_search("plan").collect()} == {"plant.md", "new plan.txt"}
    assert e.store.read("file_content_embedding").where(F.col("file_id") == note.id).count() == 0
    e.delete_task(1)
    assert [r.id for r in e.tasks().collect()] == [2]
    e.clear()
    assert e.files().count() == 0 == e.path_search("plan").count()


def test_engine_roots_settings_and_failures(spark, tmp_path):
    for name in ("a/one.txt", "b/two.txt", "b/bad.txt", "b/photo.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)

    def embed(texts):
        out = pipeline.hashing_embedder()(texts)
        with (tmp_path / "calls").open("a") as f:
            f.writelines(t.replace("\n", " ") + "\n" for t in texts)
        if any("bad.txt" in t for t in texts):
            raise ValueError("bad")
        return out

    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    e = Engine(spark, str(tmp_path / "index"), embed, buckets=2, analysers={"png": lambda data, most: "a picture of " + data.decode()})
    e.set_settings([Setting(a, keep=()), Setting(b, keep=(S.IMAGE,)), Setting(str(tmp_path / "p"), private=True)])
    assert [s.root for s in e.settings()] == [a, b, str(tmp_path / "p")]
    e.index([a])
    stored = e.store.read("file_info").select("id", F.lit(S.WAITING).alias("content_index_status"))
    e.store.commit({"file_info": Change(relational.overlay(e.store.read("file_info"), stored))})
    e.index([b])  # what waits elsewhere keeps waiting, with its chunks
    rows = {r.name: r for r in e.files().collect()}
    assert rows["one.txt"].content_index_status == S.WAITING and rows["one.txt"].content == ""
    assert e.store.read("file_content_embedding").where(F.col("file_id") == rows["one.txt"].id).count() == 1
    assert (rows["two.txt"].content, rows["photo.png"].content) == ("", "a picture of b/photo.png")
    bad = rows["bad.txt"]
    assert (bad.content_index_status, bad.content_index_status_msg, bad.meta_index_status, bad.meta_index_status_msg) == (S.FAILED, "bad", S.FAILED, "bad")
    calls = (tmp_path / "calls").read_text().splitlines()
    assert calls.count("b/two.txt") <= 2  # once, and once more by itself if it came together with the bad one
    with pytest.raises(RuntimeError):  # a task that fails says so and changes nothing
        e.on_progress = lambda step, known: (_ for _ in ()).throw(RuntimeError("no disk")) if step == "embed" else None
        e.index([a])
    assert e.tasks().first().status == "failed" and e.counts().total == 4
    e.on_progress = lambda step, known: e.stop() if step == "scan" else None
    assert e.index([a]).status == "cancelled"
    e.invalidate(bad.id, "broken")
    assert e.file(bad.id).invalid_reason == "broken" and e.file(bad.id).is_invalid
    assert e.embedder_for("multilingual") is embed


def test_engine_models_config_and_failing_sides(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "index"), buckets=2)
    e.put("model_platform", {"name": "local", "is_enable": True})
    e.put("ai_model", {"name": "m1", "platform": "local", "model_types": "chat,vision", "is_enable": True}, "name", "platform")
    e.put("ai_model", {"name": "m1", "platform": "local", "title": "First"}, "name", "platform")
    assert e.find_model("m1", "local").title == "First" and e.models("vision", "local").count() == 1 == e.models().count()
    assert [r.name for r in e.platforms(["local", "x"]).collect()] == ["local"] and e.platforms([]).count() == 0
    e.set_config("locale", "fr")
    e.set_config("locale", "de")
    assert e.config("locale") == "de" and e.config("proxy", "none") == "none"
    e.add_watch("/a")
    e.add_watch("/b")
    e.remove_watch("/a")
    assert e.watched() == ["/b"]
    other = Engine(spark, str(tmp_path / "index"), buckets=2)
    other.set_config("x", "1")
    with pytest.raises(ConcurrentChangeError):
        e.set_config("x", "2")
    e.store.refresh()
    assert e.config("x") == "1"
    e.embedder = lambda texts: 1 / 0
    assert e.hybrid_search("any thing at all").collect() == []


def test_engine_watches_late_events(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    for name in ("a.txt", "b.txt", "c.txt", "d.txt"):
        (docs / name).write_text(name)
    e = Engine(spark, str(tmp_path / "index"), buckets=2)
    e.index([str(docs)])
    for name in ("a.txt", "b.txt"):
        (docs / name).unlink()
    (docs / "d.txt").rename(docs / "e.txt")
    first = [(1, at(0), "remove", str(docs / "a.txt"), None, True, at(0)), (2, at(1), "other", None, None, None, at(1))]
    # behind the watermark; c.txt came again since
    late = [(3, at(0.5), "remove", str(docs / "b.txt"), None, True, at(2)), (4, at(0.5), "remove", str(docs / "c.txt"), None, True, at(2)),
            (5, at(0.6), "rename", str(docs / "d.txt"), str(docs / "e.txt"), True, at(2))]
    q = None
    try:
        for k, log in enumerate((first, late)):
            spark.createDataFrame(log, S.FILE_EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
            q = q or e.watch(str(tmp_path / "log"), str(tmp_path / "checkpoint"))
            q.processAllAvailable()
            names = {r.name for r in e.files().collect()}
            assert names == ({"b.txt", "c.txt", "d.txt"}, {"c.txt", "e.txt"})[k]
    finally:
        if q:
            q.stop()


def test_rename_pairing_stream(spark, tmp_path):
    rows = [(1, at(0), "rename_from", "/a", None, "r"), (2, at(0) + timedelta(milliseconds=100), "rename_to", "/b", None, "r"), (3, at(1), "rename_from", "/c", None, "r"),
            (4, at(2), "modify", "/d", None, "r"), (5, at(2), "rename_from", "/e", None, "r")]
    schema = EV.PAIRED + ", source string"
    for k, part in enumerate((rows[:1], rows[1:])):  # the halves come in two batches
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = EV.paired_stream(stream, "source").writeStream.format("memory").queryName("paired").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.kind, r.path, r.to_path) for r in spark.table("paired").collect()}
    assert got == {("rename", "/a", "/b"), ("remove", "/c", None), ("modify", "/d", None)}  # /e still waits
