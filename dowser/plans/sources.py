"""Queries of the file sources: files of every format are written into the shared folder, scanned, read and extracted."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dowser.session import temporary_folder
from dowser.sources import extract, files
from dowser.tables import table

FORMATS = ("txt", "docx", "pptx", "odt", "odp", "xlsx", "ods", "pdf")


def _zip(**members: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def made(ext: str, parts: list[str]) -> bytes:
    """A file of a format with some paragraphs, or cells, of plain text."""
    if ext == "docx":
        return _zip(**{"word__document.xml": '<w:d xmlns:w="w">' + "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in parts) + "</w:d>"})
    if ext == "pptx":
        return _zip(**{f"ppt__slides__slide{i + 1}.xml": f'<p xmlns:a="a"><a:p><a:t>{p}</a:t></a:p></p>' for i, p in enumerate(parts)})
    if ext in ("odt", "odp"):
        return _zip(**{"content.xml": '<o xmlns:text="t">' + "".join(f"<text:p>{p}</text:p>" for p in parts) + "</o>"})
    if ext == "xlsx":
        cells = "".join(f'<c r="{"ABCDEFGH"[i]}1" t="s"><v>{i}</v></c>' for i in range(len(parts)))
        return _zip(**{"xl__sharedStrings.xml": "<sst>" + "".join(f"<si><t>{p}</t></si>" for p in parts) + "</sst>", "xl__worksheets__sheet1.xml": f'<s><sheetData><row r="1">{cells}</row></sheetData></s>'})
    if ext == "ods":
        cells = "".join(f"<table:table-cell><text:p>{p}</text:p></table:table-cell>" for p in parts)
        return _zip(**{"content.xml": f'<o xmlns:table="t" xmlns:text="x"><table:table><table:table-row>{cells}</table:table-row></table:table></o>'})
    if ext == "pdf":
        body = "BT " + " T* ".join(f"({p}) Tj" for p in parts) + " ET"
        return f"%PDF\n1 0 obj <</Length {len(body)}>> stream\n{body}\nendstream endobj".encode()
    return "\n".join(parts).encode()


def scan_and_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of every customer, one of them in a hidden directory, which the scan leaves out."""
    path = temporary_folder(spark, "files")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ext = FORMATS[key % len(FORMATS)]
                for directory in (f"{path}/d{key // 100}", f"{path}/.hidden"):
                    files.write(f"{directory}/c{key}.{ext}", made(ext, [name, f"key {key}"]))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint"), "c_name")
    customers.mapInArrow(write, "n bigint").agg(F.sum("n")).collect()
    found = extract.extracted(files.read(files.scan(spark, [path]).select("path", "name", "file_ext", "category")), "content", "file_ext")
    return found.select("name", "file_ext", "category", "text")


_EXT = "list_extract([" + ", ".join(f"'{e}'" for e in FORMATS) + f"], (c_custkey % {len(FORMATS)})::int + 1)"
QUERIES = {"scan_and_extract": scan_and_extract}
SQL = {
    "scan_and_extract": f"""select 'c' || c_custkey || '.' || e as name, e as file_ext, 1 as category,
      case e when 'txt' then a || chr(10) || b when 'pptx' then chr(10) || a || chr(10) || b when 'xlsx' then a || chr(9) || b || chr(9) when 'ods' then a || chr(9) || b || chr(9)
        when 'pdf' then a || b else chr(10) || chr(10) || a || chr(10) || chr(10) || b end as text
      from (select c_custkey, c_name as a, 'key ' || c_custkey as b, {_EXT} as e from customer)""",
}
