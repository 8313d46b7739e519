"""First sheets of .xlsx workbooks, one task per file.

A workbook is a zip of XML parts and cannot be split, so parallelism comes from the
number of files.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.sources.readers import _infer, _missing_texts, _struct
from tabloom.types import col

# fixed values: XML names of the spreadsheet format
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
SHEET_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column_index(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def _texts(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{MAIN}t"))


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Cell texts of the first sheet, row by row."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = [_texts(si) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        wanted = next(book.iter(f"{MAIN}sheet")).get(SHEET_ID)
        links = ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        target = next(r.get("Target") for r in links if r.get("Id") == wanted).lstrip("/")
        with z.open(target if target.startswith("xl/") else f"xl/{target}") as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{MAIN}row":
                    continue
                cells: list[str | None] = []
                for i, c in enumerate(row.iter(f"{MAIN}c")):
                    at = _column_index(c.get("r")) if c.get("r") else i
                    cells += [None] * (at - len(cells) + 1)
                    value, kind = c.find(f"{MAIN}v"), c.get("t")
                    if kind == "inlineStr":
                        cells[at] = _texts(c)
                    elif value is not None and kind == "s":
                        cells[at] = shared[int(value.text)]
                    elif value is not None and kind == "b":
                        cells[at] = "true" if value.text == "1" else "false"
                    elif value is not None:
                        cells[at] = value.text
                row.clear()
                yield cells


def read_workbooks(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """All workbooks of a path or pattern as one table; the first row names the columns.
    The names come from the given schema or from the first file."""
    files = spark.read.format("binaryFile").load(path)
    if schema is not None:
        names = _struct(spark, schema).fieldNames()
    else:
        first = files.agg(F.min("path")).first()[0]  # reads no contents

        def top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for content in batch["content"]:
                    row = next(sheet_rows(bytes(content)), [])
                    yield pd.DataFrame({"i": range(len(row)), "name": row}, dtype=object).astype({"i": int})

        one = spark.read.format("binaryFile").load(first).select("content").mapInPandas(top, "i int, name string")
        names = [r["name"] or f"Unnamed: {r['i']}" for r in one.orderBy("i").collect()]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = sheet_rows(bytes(content))
                head = [n or f"Unnamed: {i}" for i, n in enumerate(next(rows, []))]
                block: list = []
                for r in rows:
                    cells = dict(zip(head, r))
                    block.append([cells.get(n) for n in names])
                    if len(block) == 10_000:
                        yield pd.DataFrame(block, columns=names, dtype=object)
                        block = []
                yield pd.DataFrame(block, columns=names, dtype=object)

    texts = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = _missing_texts(files.select("content").mapInPandas(parse, texts))
    fields = _struct(spark, schema).fields if schema is not None else _infer(raw, 1.0).fields
    return raw.select(*[col(f.name).try_cast(f.dataType).alias(f.name) for f in fields])


