"""Input files and the page tables read from them.

Every reader keeps one file's failure in that file's rows: an error column, never a failed task.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable
from itertools import islice
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pdf import read_pdf

#: Accepted extensions by kind.
KINDS = {".pdf": "pdf", ".png": "image", ".jpg": "image", ".jpeg": "image", ".docx": "docx", ".md": "markdown", ".markdown": "markdown"}

_PAGES = "path string, ext string, page_index int, text string, source string, image_count int, image_coverages array<double>, extraction_issue string, reliable boolean, error string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


#: Pages a task holds before it hands them on.
PAGES_AT_ONCE = 256


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def file_system(uri: str):
    """The file system of a path or URI, and the path in it, for use in tasks."""
    from pyarrow import fs

    if re.match(r"file:/*", uri):
        uri = re.sub(r"^file:/*", "/", uri)
    return (fs.LocalFileSystem(), uri) if "://" not in uri else fs.FileSystem.from_uri(uri)


def open_bytes(uri: str) -> bytes:
    fs, path = file_system(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


def read_files(spark: SparkSession, paths: str | Iterable[str], recursive: bool = True) -> DataFrame:
    """path, ext, length, mtime, content, ordinal_key: accepted files.

    One path: a file, or a directory with its subdirectories in the order of lower-cased paths.  A list: its existing files
    in the given order; directories in it are not read.  The extension is compared without case, so by column, not by glob.
    """
    if isinstance(paths, str):
        df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(paths)
        return _accepted(df).withColumn("ordinal_key", F.lower("path"))
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found: dict[str, str] = {}
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(conf)
        if fs.exists(where) and fs.getFileStatus(where).isFile():
            found.setdefault(fs.makeQualified(where).toString(), f"{len(found):012d}")
    if not found:
        return spark.createDataFrame([], "path string, ext string, length bigint, mtime timestamp, content binary, ordinal_key string")
    given = spark.createDataFrame(list(found.items()), "path string, ordinal_key string")
    return _accepted(spark.read.format("binaryFile").load(list(found))).join(F.broadcast(given), "path")


def _accepted(df: DataFrame) -> DataFrame:
    df = df.select("path", extension(F.col("path")).alias("ext"), "length", F.col("modificationTime").alias("mtime"), "content")
    return df.where(F.col("ext").isin(list(KINDS)))


def complete_pdf(content: Column) -> Column:
    """Start and end marks where a whole file has them: the first 1,024 and the last 65,536 bytes."""
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    tail = F.decode(F.expr("substring(content, greatest(1, length(content) - 65535))"), "ISO-8859-1")
    return (F.length(content) >= 12) & head.contains("%PDF-") & tail.contains("%%EOF")


def docx_text(content: bytes) -> str:
    """Headers' paragraphs, the body's, then its tables, then footers'; each stripped, blank ones left out."""
    out: list[str] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = sorted(z.namelist())

        def paragraphs(root: ElementTree.Element) -> Iterable[str]:
            for p in root:
                if p.tag == f"{_W}p":
                    yield _paragraph(p)

        for part in ("header", None, "footer"):
            if part is None:
                body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
                out += paragraphs(body)
                out += [_table(t) for t in body if t.tag == f"{_W}tbl"]
            else:
                for name in names:
                    if re.fullmatch(rf"word/{part}\d*\.xml", name):
                        out += paragraphs(ElementTree.fromstring(z.read(name)))
    return "\n".join(s for s in (x.strip() for x in out) if s)


def _paragraph(p: ElementTree.Element) -> str:
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n"}
    return "".join((e.text or "") if e.tag == f"{_W}t" else marks.get(e.tag, "") for e in p.iter())


def _table(t: ElementTree.Element) -> str:
    rows = ("\t".join(" ".join("\n".join(_paragraph(p) for p in cell.iter(f"{_W}p")).split()) for cell in row.iter(f"{_W}tc")).strip() for row in t.iter(f"{_W}tr"))
    return "\n".join(r for r in rows if r)


def flatten_tables(cells: DataFrame, table: list[str], row: str, column: str, text: str) -> DataFrame:
    """table..., text: cells joined by tabs, rows by line ends, white space inside cells collapsed, empty rows dropped."""
    clean = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "))
    rows = cells.groupBy(*table, row).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(column), clean.alias("_t")))), lambda c: c["_t"]), "\t").alias("_r"))
    rows = rows.withColumn("_r", F.regexp_replace("_r", r"^\s+|\s+$", "")).where("_r <> ''")
    return rows.groupBy(*table).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(row, "_r"))), lambda r: r["_r"]), "\n").alias("text"))


def read_pages(files: DataFrame) -> DataFrame:
    """One row per page of every file: path, ext, page_index, text, source, image facts, extraction_issue, error.

    A file of unknown kind or that cannot be read gives one row with an error and no page.
    Images come without text; run_ocr gives them one.
    """
    import pyarrow as pa

    columns = [x.split()[0] for x in _PAGES.split(", ")]
    types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.string(), pa.bool_(), pa.string()]

    def pages(path: str, ext: str, content: bytes) -> Iterable[tuple]:
        kind = KINDS.get(ext)
        try:
            if kind == "markdown":
                yield path, ext, 0, content.decode("utf-8"), "markdown", 0, None, None, True, None
            elif kind == "docx":
                yield path, ext, 0, docx_text(content), "docx", 0, None, None, True, None
            elif kind == "image":
                yield path, ext, 0, "", "imagem-ocr", 1, None, None, True, None
            elif kind == "pdf":
                for p in read_pdf(content):
                    yield path, ext, p.index, p.text, "nativo", p.image_count, p.coverages, p.issue, p.reliable, None
            else:
                yield path, ext, None, None, None, None, None, None, None, f"Formato não suportado: {ext}"
        except Exception as e:  # noqa: BLE001
            yield path, ext, None, None, None, None, None, None, None, f"Erro durante processamento: {e}"

    def rows(batches):
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("path", "ext", "content")), strict=True):
                yield from pages(*row)

    def run(batches):
        every = rows(batches)
        while out := list(islice(every, PAGES_AT_ONCE)):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types, strict=True)], names=columns)

    return files.select("path", "ext", "content").mapInArrow(run, _PAGES)
