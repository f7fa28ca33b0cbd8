"""Sources: report files (PDF), JSON documents, file listings, header rows."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.operators.text_blocks import is_large, join_pages

PAGES_DDL = "path string, pages array<string>, used_ocr boolean, error string"


def setting(spark: SparkSession, name: str, variable: str, default: str | None = None, order: tuple[str, ...] = ("conf", "env")) -> str:
    """A setting from the session's configuration, the environment or its default, in the order asked for; without any an error."""
    sources = {"conf": lambda: spark.conf.get(name, None), "env": lambda: os.environ.get(variable)}
    value = next((v for v in (sources[o]() for o in order) if v), default)
    if value is None:
        raise ValueError(f"neither {name} nor {variable} is set")
    return value


def require(**parameters: str | None) -> None:
    """Refuse parameters that are null or blank, all of them named."""
    if lacking := sorted(k for k, v in parameters.items() if not (v or "").strip()):
        raise ValueError(f"missing: {', '.join(lacking)}")


def listing(spark: SparkSession, path: str, glob: str = "*.json") -> list[str]:
    """Names of the files in order of code points. Never kept, so a new file is there at once."""
    return [r.nom for r in files(spark, path, glob).select("nom").orderBy("nom").collect()]


def files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, nom, length, modificationTime): names only, contents aren't read. Order by ``nom`` for the sorted listing."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return listed.select("path", F.element_at(F.split("path", "/"), -1).alias("nom"), "length", "modificationTime")


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, raw, valide): one JSON document per file, whole."""
    read = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(F.input_file_name().alias("path"), F.col("value").alias("raw"))
    return read.withColumn("valide", F.try_parse_json("raw").isNotNull())


def _pdf(ocr_below: int, dpi: int, language: str):
    def pages_of(content: bytes) -> tuple[list[str], bool]:
        import io

        import pdfplumber

        with pdfplumber.open(io.BytesIO(content)) as pdf:
            pages = [p.extract_text(x_tolerance=2, y_tolerance=1) or "" for p in pdf.pages]
        if len("\n".join(pages).strip()) >= ocr_below or not (importlib.util.find_spec("pytesseract") and importlib.util.find_spec("pdf2image")):
            return pages, False
        import pdf2image
        import pytesseract

        return [pytesseract.image_to_string(i, lang=language) for i in pdf2image.convert_from_bytes(content, dpi=dpi)], True

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.append((path, *pages_of(content), None))
                except Exception as e:  # noqa: BLE001 - an unreadable file is a row with its error
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "pages", "used_ocr", "error"])

    return run


def pdf_reports(spark: SparkSession, path: str, ocr_below: int = 30, dpi: int = 300, language: str = "fra") -> DataFrame:
    """(path, pages, used_ocr, error, full_text, page_count, char_count, is_large_pdf) of the PDF files under ``path``.

    A document whose text has fewer than ``ocr_below`` characters is read as images where the OCR libraries are
    installed. A file that can't be read, or a missing PDF library, is told in ``error``.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")
    read = raw.mapInPandas(_pdf(ocr_below, dpi, language), PAGES_DDL).withColumn("full_text", join_pages(F.col("pages")))
    counted = read.withColumn("page_count", F.size(F.coalesce("pages", F.array().cast("array<string>")))).withColumn("char_count", F.length("full_text"))
    return counted.withColumn("is_large_pdf", is_large(F.col("page_count"), F.col("char_count")))


def csv_headers(spark: SparkSession, path: str) -> list[str]:
    """Header row of a CSV target, stripped; an empty one is an error."""
    names = [c.strip() for c in spark.read.option("header", "true").csv(path).columns]
    if not any(names):
        raise ValueError(f"{path}: the target has no header")
    return names


def workbook_headers(path: str, sheet: str, table: str) -> tuple[list[str], tuple[int, int, int, int]]:
    """(header row, (first column, first row, last column, last row)) of a named table of a workbook, where the library is installed."""
    import openpyxl

    from papyrine.sources.sinks import table_bounds

    book = openpyxl.load_workbook(path, read_only=False)
    if sheet not in book.sheetnames or table not in book[sheet].tables:
        raise ValueError(f"{path}: no table {table} on sheet {sheet}")
    ws = book[sheet]
    ref = ws.tables[table].ref
    return [str(c.value or "").strip() for c in ws[ref][0]], table_bounds(ref)
