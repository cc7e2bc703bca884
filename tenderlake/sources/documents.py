"""Parsers of file content, run over binary rows on the executors.

A parser takes a file's bytes and returns pages or blocks; what it raises becomes the
file's error, and the file has neither. DOCX needs the standard library only. PDF goes
through a plug-in, by default pdfplumber where it is installed.
"""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.text import sanitize
from ..operators.columns import columnar_or_plain
from ..operators.quality import metric
from .discover import local_path

#: Caps against archives that unpack to far more than they are.
MOST_UNPACKED, MOST_RATIO = 1 << 30, 200
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def archive_error(data: bytes, most: int = MOST_UNPACKED, ratio: int = MOST_RATIO) -> str | None:
    """Why an archive should not be unpacked, if it should not."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        members = archive.infolist()
    total = sum(m.file_size for m in members)
    if total > most:
        return f"decompression-bomb suspect: declared uncompressed size {total} bytes exceeds cap of {most} bytes"
    for m in members:
        if m.compress_size > 0 and m.file_size / m.compress_size > ratio:
            return f"decompression-bomb suspect: member '{m.filename}' compression ratio exceeds {ratio}x"
    return None


def _paragraph_text(node: ET.Element) -> str:
    out = []
    for x in node.iter():
        if x.tag == f"{_W}t":
            out.append(x.text or "")
        elif x.tag == f"{_W}tab":
            out.append("\t")
        elif x.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
    return sanitize("".join(out))


def docx_blocks(data: bytes) -> list[dict]:
    """Paragraphs and tables of a document's body, in order; raises on anything that is no such file."""
    error = archive_error(data)
    if error:
        raise ValueError(error)
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        body = ET.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
        styles = {}
        if "word/styles.xml" in archive.namelist():
            for s in ET.fromstring(archive.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                styles[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else None
    blocks = []
    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            name = styles.get(style.get(f"{_W}val")) if style is not None else "Normal"
            blocks.append({"ordinal": len(blocks), "kind": "paragraph", "text": _paragraph_text(node), "style": name, "table": None})
        elif node.tag == f"{_W}tbl":
            table = [["\n".join(_paragraph_text(p) for p in cell.iter(f"{_W}p")) for cell in row.findall(f"{_W}tc")] for row in node.findall(f"{_W}tr")]
            blocks.append({"ordinal": len(blocks), "kind": "table", "text": "", "style": None, "table": table})
    return blocks


def pdf_pages(data: bytes) -> list[dict]:
    """Pages by pdfplumber, with their words' places, and a layout reading of the first; raises where it isn't installed."""
    import pdfplumber

    pages = []
    with pdfplumber.open(io.BytesIO(data)) as pdf:
        for number, page in enumerate(pdf.pages, 1):
            text = sanitize(page.extract_text(x_tolerance=3, y_tolerance=3) or "")
            try:
                words = [{"text": sanitize(w["text"]), "x0": float(w["x0"]), "top": float(w["top"])} for w in page.extract_words(x_tolerance=3, y_tolerance=3)]
            except Exception:  # noqa: BLE001  a page without places is read as it is
                words = []
            images = page.images if hasattr(page, "images") else page.objects.get("image", [])
            laid = sanitize(page.extract_text(layout=True) or "") if number == 1 else None
            pages.append({"page_number": number, "text": text, "char_count": len(page.chars), "metrics": text_metrics(text, bool(images)), "height": float(page.height), "words": words, "layout_text": laid})
            page.close()
    return pages


def text_metrics(text: str, has_images: bool) -> dict[str, float]:
    return {"cid_count": float(text.count("(cid:")), "replacement_char_count": float(text.count("\ufffd")), "has_images": float(has_images)}


BLOCKS = "file_id string, parse_status string, error string, blocks array<struct<ordinal:int,kind:string,text:string,style:string,table:array<array<string>>>>"
PAGES = "file_id string, parse_status string, error string, pages array<struct<page_number:int,text:string,char_count:int,metrics:map<string,double>,height:double,words:array<struct<text:string,x0:double,top:double>>,layout_text:string>>"
#: What a PDF parser may leave out.
OPTIONAL = {"height": None, "words": [], "layout_text": None}


def _parsed(parse: Callable[[bytes], list[dict]], column: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file_id, path, data in zip(batch["file_id"], batch["path"], batch["content"]):
                try:
                    if data is None:
                        with open(local_path(path), "rb") as f:
                            data = f.read()
                    got = parse(bytes(data))
                    rows.append((file_id, "ok", None, [OPTIONAL | x for x in got] if column == "pages" else got))
                except Exception as e:  # noqa: BLE001  whatever a file does, it is a row
                    rows.append((file_id, "failed", str(e) or type(e).__name__, []))
            yield pd.DataFrame(rows, columns=["file_id", "parse_status", "error", column])

    return run


def parsed_files(found: DataFrame, kind: str, parse: Callable[[bytes], list[dict]] | None = None) -> DataFrame:
    """One row per file of a kind: file_id, parse_status, error, and pages or blocks.

    Files on a mounted file system are opened where they are parsed; others come through
    Spark's reader. Store the result: every file is parsed each time that it is read.
    """
    spark = found.sparkSession
    chosen = found.where(F.col("kind") == kind).select("path", "file_id")
    remote = [r.path for r in chosen.where(~F.col("path").startswith("file:")).select("path").collect()]
    none = F.lit(None).cast("binary").alias("content")
    rows = chosen.where(F.col("path").startswith("file:")).select("file_id", "path", none)
    if remote:
        content = spark.read.format("binaryFile").option("ignoreCorruptFiles", True).load(remote).select("path", "content")
        rows = rows.unionByName(chosen.where(~F.col("path").startswith("file:")).join(content, "path", "left").select("file_id", "path", "content"))
    return parsed_content(rows, kind, parse)


def parsed_content(rows: DataFrame, kind: str, parse: Callable[[bytes], list[dict]] | None = None) -> DataFrame:
    """As parsed_files, of rows (file_id, path, content); content is null where the path is to be opened."""
    column, schema = ("pages", PAGES) if kind == "pdf" else ("blocks", BLOCKS)
    return rows.mapInPandas(_parsed(parse or (pdf_pages if kind == "pdf" else docx_blocks), column), schema)


def statuses(parsed: DataFrame) -> DataFrame:
    """(file_id, parse_status, error, count) of parsed files."""
    column = "pages" if "pages" in parsed.columns else "blocks"
    return parsed.select("file_id", "parse_status", "error", F.size(column).alias("count"))


def block_rows(parsed: DataFrame) -> DataFrame:
    return parsed.select("file_id", F.inline("blocks"))


def page_rows(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages: file_id, page_number, text, char_count, metrics; layouts: file_id, layout_text of first pages).

    Pages that are set in columns are read by rows of their layout, and their metrics
    counted anew on that text.
    """
    rows = parsed.select("file_id", F.inline("pages"))
    words = rows.select("file_id", "page_number", F.inline("words"))
    laid = columnar_or_plain(rows.drop("words", "layout_text"), words, rows.select("file_id", "page_number", "height"))
    again = F.create_map(F.lit("cid_count"), metric("cid_count", F.col("text")), F.lit("replacement_char_count"), metric("replacement_char_count", F.col("text")))
    kept = F.map_filter("metrics", lambda k, _: ~k.isin("cid_count", "replacement_char_count"))
    pages = laid.withColumn("metrics", F.when(F.col("columnar"), F.map_concat(kept, again)).otherwise(F.col("metrics")))
    return pages.select("file_id", "page_number", "text", "char_count", "metrics"), rows.where("page_number = 1").select("file_id", "layout_text")


def empty_pages(spark) -> DataFrame:
    return spark.createDataFrame([], "file_id string, page_number int, text string, char_count int, metrics map<string,double>")
