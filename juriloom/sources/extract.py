"""Text of files: plain text, CSV, Markdown and HTML natively; PDF and office formats where their libraries are there."""

from __future__ import annotations

import html
import io
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_filename
from ..functions.vocabulary import DOCUMENT_MINIMUM, PAGE_MINIMUM

SCHEMA = "document_id string, locator string, text string, error string"
HEADER_END = "\n---"


def decode(data: bytes) -> str:
    """UTF-8 with or without a mark, UTF-16 by its mark, Windows-1252, else UTF-8 with replacements."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    for encoding in ("utf-8-sig", "cp1252"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def _pdf(data: bytes) -> Iterator[tuple[str, str]]:
    import fitz

    with fitz.open(stream=data, filetype="pdf") as pages:
        for number, page in enumerate(pages, 1):
            yield f"Page {number}", page.get_text()


def _docx(data: bytes) -> Iterator[tuple[str, str]]:
    import docx

    document = docx.Document(io.BytesIO(data))
    lines = [p.text for p in document.paragraphs if p.text.strip()]
    for table in document.tables:
        lines += [f"Row {i}: " + " | ".join(c.text.strip() for c in row.cells) for i, row in enumerate(table.rows, 1)]
    yield "Section 1", "\n".join(lines)


def sheet_rows(rows: list[list]) -> str:
    """Rows with a value as "Row n: a | b"."""
    texts = [["" if v is None else str(v).strip() for v in row] for row in rows]
    return "\n".join(f"Row {i}: " + " | ".join(t) for i, t in enumerate(texts, 1) if any(t))


def _sheets(data: bytes) -> Iterator[tuple[str, str]]:
    for name, frame in pd.read_excel(io.BytesIO(data), sheet_name=None, header=None).items():
        yield f"Sheet: {name}", sheet_rows(frame.astype(object).where(frame.notna(), None).values.tolist())


def _html(data: bytes) -> Iterator[tuple[str, str]]:
    text = re.sub(r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ", decode(data))
    text = re.sub(r"(?i)</?(?:p|div|br|li|tr|h[1-6]|section|article)\b[^>]*>", "\n", text)
    yield "Section 1", "\n".join(filter(None, (" ".join(x.split()) for x in html.unescape(re.sub(r"<[^>]*>", "", text)).split("\n"))))


def _plain(data: bytes) -> Iterator[tuple[str, str]]:
    yield "Section 1", decode(data)


READERS: dict[str, Callable[[bytes], Iterator[tuple[str, str]]]] = {".pdf": _pdf, ".docx": _docx, ".xlsx": _sheets, ".xls": _sheets, ".html": _html, ".htm": _html, ".txt": _plain, ".md": _plain, ".csv": _plain}


def extract(files: DataFrame, ocr: Callable[[bytes, str], str] | None = None) -> DataFrame:
    """(document_id, locator, text, error), a row per page, sheet or section; a file that fails is a row with its error.
    files: document_id, extension, content. ocr is asked for pages of fewer than the least characters."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, extension, content in zip(frame.document_id, frame.extension, frame.content, strict=True):
                try:
                    rows = [(key, where, text, None) for where, text in READERS[(extension or "").lower()](bytes(content or b""))]
                    if ocr is not None:
                        rows = [(k, w, ocr(bytes(content), w) if w.startswith("Page") and len(t.strip()) < PAGE_MINIMUM else t, e) for k, w, t, e in rows]
                except KeyError:
                    rows = [(key, None, None, f"unsupported extension {extension}")]
                except Exception as problem:  # one bad file must not fail the task
                    rows = [(key, None, None, f"{type(problem).__name__}: {problem}"[:500])]
                yield pd.DataFrame(rows, columns=["document_id", "locator", "text", "error"])

    return files.select("document_id", "extension", "content").mapInPandas(run, SCHEMA)


def extraction_status(parts: DataFrame) -> DataFrame:
    """(document_id, status, character_count, page_count): ready from the least number of characters on."""
    rows = parts.groupBy("document_id").agg(
        F.coalesce(F.sum(F.length(F.trim("text"))), F.lit(0)).alias("character_count"),
        F.count_if(F.col("locator").startswith("Page")).alias("page_count"),
        F.bool_or(F.col("error").isNotNull()).alias("failed"),
    )
    short = F.when(F.col("page_count") > 0, "needs_ocr").otherwise("insufficient_text")
    return rows.select("document_id", F.when(F.col("failed"), "error").when(F.col("character_count") >= DOCUMENT_MINIMUM, "ready").otherwise(short).alias("status"), "character_count", "page_count")


def page_outcome(parts: DataFrame, ocr_used: bool = False) -> DataFrame:
    """(document_id, empty_pages, ocr_pages, warnings): the numbers of the pages that hold too little text, of those that
    character recognition was asked for, and what went wrong. parts: extract()."""
    number = F.regexp_extract(F.coalesce("locator", F.lit("")), r"^Page (\d+)$", 1).try_cast("int")
    thin = number.isNotNull() & (F.length(F.trim(F.coalesce("text", F.lit("")))) < PAGE_MINIMUM)
    pages = lambda c: F.array_sort(F.collect_list(F.when(c, number)))
    return parts.groupBy("document_id").agg(pages(thin).alias("empty_pages"), pages(thin & F.lit(ocr_used)).alias("ocr_pages"), F.array_sort(F.collect_list("error")).alias("warnings"))


def header(title: Column, source: Column, category: Column, date: Column, url: Column, note: Column) -> Column:
    """The metadata lines before extracted text; lines without a value are left out."""
    line = lambda name, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(name + ": "), x))
    return F.concat_ws("\n", F.concat(F.lit("# "), title), line("Source", source), line("Category", category), line("Date", date), line("URL", url), line("Note", note), F.lit(HEADER_END.lstrip()))


def output_name(document_id: Column, filename: Column) -> Column:
    """The name of the file that holds a document's extracted text."""
    return F.concat(document_id, F.lit("__"), safe_filename(F.regexp_replace(filename, r"(?<=.)\.[^.]*$", "")), F.lit(".md"))


def file_sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def write_texts(texts: DataFrame, path: str) -> None:
    """Write extracted texts (document_id, filename, text) as a table with the names of their files; one row a document."""
    named = texts.select("document_id", output_name(F.col("document_id"), F.col("filename")).alias("name"), "text", file_sha256(F.col("text")).alias("extracted_sha256"))
    named.write.mode("overwrite").parquet(path)


def marked_text(parts: DataFrame) -> DataFrame:
    """(document_id, text): the parts of each document under their headings, in order of pos."""
    body = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat(F.lit("## "), "locator", F.lit("\n\n"), "text").alias("t")))), lambda x: x["t"])
    return parts.groupBy("document_id").agg(F.array_join(body, "\n\n").alias("text"))
