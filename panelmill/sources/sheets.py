"""Excel sheets as a Spark data source: ``spark.read.format("xlsx_rows")``, and the crosswalk read from one.

The reader needs nothing but the standard library: a workbook is a zip of XML parts. A file is one task, as a sheet
cannot be split; a folder of workbooks is as many tasks as files. Paths must be readable by the workers.
"""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from panelmill.functions import scalars as S

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
SCHEMA = "file string, row long, cells array<string>"


def _column(reference: str) -> int:
    """The number of a cell's column from 0: A, B, ..., Z, AA, ..."""
    n = 0
    for c in reference.upper():
        if not "A" <= c <= "Z":
            break
        n = 26 * n + ord(c) - 64
    return n - 1


def _text(node) -> str:
    """The runs of a string, without phonetic hints."""
    return "".join(t.text or "" for part in node if part.tag in (f"{_MAIN}t", f"{_MAIN}r") for t in ([part] if part.tag == f"{_MAIN}t" else part.findall(f"{_MAIN}t")))


def sheet_rows(data: bytes, sheet: str | None = None) -> Iterator[tuple[int, list[str | None]]]:
    """(row number from 1, cells) of a sheet, the first if none is named. Empty cells are null; numbers, strings and
    truth values come as they are stored; rows without cells are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [_text(si) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall(f"{_MAIN}si")]
        links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        sheets = {x.get("name"): links[x.get(_LINK)] for x in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")}
        if sheet is not None and sheet not in sheets:
            raise ValueError(f"no sheet {sheet!r} among {sorted(sheets)}")
        target = sheets[sheet] if sheet is not None else next(iter(sheets.values()))
        part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        number = 0
        with book.open(part) as stream:
            for _, node in ElementTree.iterparse(stream):
                if node.tag != f"{_MAIN}row":
                    continue
                number = int(node.get("r", number + 1))
                cells: list[str | None] = []
                for cell in node.findall(f"{_MAIN}c"):
                    at = _column(cell.get("r", "")) if cell.get("r") else len(cells)
                    cells += [None] * (at - len(cells))
                    value, kind = cell.find(f"{_MAIN}v"), cell.get("t")
                    if kind == "inlineStr":
                        inline = cell.find(f"{_MAIN}is")
                        cells.append(None if inline is None else _text(inline))
                    elif value is None or value.text is None:
                        cells.append(None)
                    else:
                        cells.append(shared[int(value.text)] if kind == "s" else value.text)
                node.clear()
                if cells:
                    yield number, cells


class _Book(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.sheet = options["path"], options.get("sheet")

    def partitions(self):
        if os.path.isdir(self.path):
            return [_Book(os.path.join(self.path, f)) for f in sorted(os.listdir(self.path)) if f.lower().endswith(".xlsx")]
        return [_Book(self.path)]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            data = f.read()
        for number, cells in sheet_rows(data, self.sheet):
            yield os.path.basename(partition.path), number, cells


class SheetSource(DataSource):
    """Rows (file, row, cells) of one sheet of each workbook. Options: path (a file or folder), sheet."""

    @classmethod
    def name(cls) -> str:
        return "xlsx_rows"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def read_sheet(spark: SparkSession, path: str, words: list[list[str]], sheet: str | None = None) -> DataFrame:
    """(file, row, c0, c1, ...): the columns whose header holds all words of an entry of ``words``, lower case, below
    the first row in which every entry has such a column. Of several columns the first counts; no such row is an error.
    """
    spark.dataSource.register(SheetSource)
    reader = spark.read.format("xlsx_rows")
    rows = (reader.option("sheet", sheet) if sheet else reader).load(path)
    # headers stand near the top of a file: one row a file comes back
    low = F.transform("cells", lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))

    def place(own: list[str]):
        hit = F.transform("low", lambda c: F.forall(F.array(*[F.lit(w) for w in own]), lambda w: F.contains(c, w)))
        return F.array_position(hit, True)

    found = rows.withColumn("low", low).select("file", "row", F.array(*[place(w) for w in words]).alias("at")).where(F.forall("at", lambda p: p > 0))
    head = found.groupBy("file").agg(F.min_by("at", "row").alias("at"), F.min("row").alias("head"))
    if not head.limit(1).count():
        raise ValueError(f"no row of {path} names {words}")
    body = rows.join(head, "file").where(F.col("row") > F.col("head"))
    return body.select("file", "row", *[F.get("cells", (F.col("at")[k] - 1).cast("int")).alias(f"c{k}") for k in range(len(words))])


def county_crosswalk(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """(county_fips, cbsa_code, cbsa_title) of metropolitan areas: state and county codes padded and joined, distinct."""
    table = read_sheet(spark, path, [["cbsa", "code"], ["cbsa", "title"], ["metropolitan", "statistical"], ["fips", "state"], ["fips", "county"]], sheet)
    cbsa, title, kind, state, county = (F.col(f"c{k}") for k in range(5))
    out = table.where(F.lower(kind).contains("metropolitan") & cbsa.isNotNull() & state.isNotNull() & county.isNotNull())
    return out.select(F.concat(S.padded_code(state, 2), S.padded_code(county, 3)).alias("county_fips"), S.padded_code(cbsa, 5).alias("cbsa_code"), F.trim(title).alias("cbsa_title")).distinct()
