"""Sinks: documents by key, rows appended to a target with a ledger against repetition."""

from __future__ import annotations

import io
import os
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from papyrine.operators.dedup import latest_by_key
from papyrine.functions.scalar import safe_file_name
from papyrine.operators.records import align_to_headers, holds_something, new_payloads, payload_json


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def write_documents(df: DataFrame, path: str, name: str, raw: str) -> None:
    """One JSON text per ``name``; a name that is written again replaces its document only."""
    df.select(F.col(name).alias("nom"), F.col(raw).alias("json")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("nom").parquet(path)


def write_records(df: DataFrame, path: str, name: str, term: str, raw: str) -> None:
    """Records as JSON under their declared names, without nulls, one per training and term: ``<name>_<term>.json`` is its key, and
    a record that is written again replaces the one of its key only."""
    named = df.select(safe_file_name(F.col(name), F.col(term)).alias("nom"), payload_json(F.col(raw)).alias("raw"))
    write_documents(named.where("raw is not null"), path, "nom", "raw")


def upsert(df: DataFrame, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """What ``path`` holds with ``df`` put in: the latest row of each key. The caller writes it elsewhere and swaps."""
    held = _read(df.sparkSession, path, df.schema.simpleString().removeprefix("struct<").removesuffix(">"))
    return latest_by_key(held.unionByName(df), keys, order)


@dataclass(frozen=True)
class Appended:
    """How many rows were appended, and the index of the last row of the target, its header counted as row 1."""

    rows: int
    last: int


def append_rows(df: DataFrame, headers: list[str], path: str, ledger_path: str, key: str = "hash", raw: str | None = None) -> Appended:
    """Append the rows the ledger doesn't know, aligned to ``headers``. Rows whose JSON ``raw`` is an empty object, or no object, stay out.

    The ledger is written after the rows, so a failure in between appends them again: at least once. Equal rows of one call
    are appended once.
    """
    spark = df.sparkSession
    if raw is not None:
        df = df.where(holds_something(F.col(raw)))
    fresh = new_payloads(df.dropDuplicates([key]), _read(spark, ledger_path, f"{key} string"), key)
    fresh = fresh.persist()
    try:
        n = fresh.count()
        if n:
            align_to_headers(fresh, headers).write.mode("append").parquet(path)
            fresh.select(key).write.mode("append").parquet(ledger_path)
    finally:
        fresh.unpersist()
    return Appended(n, 1 + _read(spark, path, ", ".join(f"c{k} string" for k in range(len(headers)))).count())


# --- workbooks -------------------------------------------------------------------------------------------------------------


def _column_number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = 26 * n + ord(c) - 64
    return n


def _column_letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def table_bounds(ref: str) -> tuple[int, int, int, int]:
    """(first column, first row, last column, last row) of a range such as ``B2:D9``."""
    m = re.fullmatch(r"\$?([A-Za-z]+)\$?(\d+)(?::\$?([A-Za-z]+)\$?(\d+))?", ref)
    if not m:
        raise ValueError(f"no range: {ref}")
    a, b = (_column_number(m[1]), int(m[2])), (_column_number(m[3] or m[1]), int(m[4] or m[2]))
    return a[0], a[1], b[0], b[1]


def cell_text(value: object) -> str:
    """A cell as text: null is empty, a list its non-blank items joined, an object its JSON."""
    import json

    if value is None:
        return ""
    if isinstance(value, (list, tuple)):
        return " • ".join(t for t in (str(x) for x in value if x is not None) if t.strip())
    return json.dumps(value, ensure_ascii=False) if isinstance(value, dict) else str(value)


@dataclass(frozen=True)
class TableAppend:
    """What appending a row to a named table changes: cells by (row, column), the table's new range, the row, the keys without a
    column and the columns without a value, both sorted."""

    cells: dict[tuple[int, int], str]
    ref: str
    row: int
    keys_without_column: list[str]
    columns_without_value: list[str]


def plan_table_append(ref: str, headers: list[str], record: dict) -> TableAppend:
    """The row goes right below the table, from its first column on; of repeated headers only the last is filled."""
    left, top, right, bottom = table_bounds(ref)
    last = {h: k for k, h in enumerate(headers)}
    cells = {(bottom + 1, left + k): cell_text(record.get(h)) if last[h] == k else "" for k, h in enumerate(headers)}
    return TableAppend(cells, f"{_column_letters(left)}{top}:{_column_letters(right)}{bottom + 1}", bottom + 1, sorted(k for k in record if k not in last), sorted(h for h in headers if h not in record))


def _append_to_sheet(book, record: dict, sheet: str, table: str) -> TableAppend:
    if sheet not in book.sheetnames:
        raise ValueError(f"no sheet {sheet}")
    ws = book[sheet]
    if table not in ws.tables:
        raise ValueError(f"no table {table} on sheet {sheet}")
    left, top, right, _ = table_bounds(ws.tables[table].ref)
    headers = [str(ws.cell(row=top, column=c).value or "").strip() for c in range(left, right + 1)]
    plan = plan_table_append(ws.tables[table].ref, headers, record)
    for (row, column), value in plan.cells.items():
        ws.cell(row=row, column=column, value=value)
    ws.tables[table].ref = plan.ref
    return plan


def append_to_workbook(record: dict, path: str, sheet: str, table: str) -> TableAppend:
    """Append one record to a named table of a workbook file, where the workbook library is installed. The file must exist."""
    import openpyxl

    if not os.path.exists(path):
        raise FileNotFoundError(f"no workbook at {path}")
    book = openpyxl.load_workbook(path)
    plan = _append_to_sheet(book, record, sheet, table)
    book.save(path)
    return plan


def append_to_workbook_bytes(record: dict, content: bytes, sheet: str, table: str) -> tuple[bytes, TableAppend]:
    """The same in memory: the workbook comes and goes as bytes."""
    import openpyxl

    book = openpyxl.load_workbook(io.BytesIO(content))
    plan = _append_to_sheet(book, record, sheet, table)
    out = io.BytesIO()
    book.save(out)
    return out.getvalue(), plan
