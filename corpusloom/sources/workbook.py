"""A data source for sheets of .xlsx workbooks, read from the archive's XML."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def sheet_names(path: str) -> list[str]:
    with zipfile.ZipFile(path) as z:
        return [x.get("name") for x in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]


def sheet_rows(path: str, sheet: str) -> Iterator[tuple[int, dict[int, str]]]:
    """(physical row number, texts by column from 0) of a sheet; whole numbers have no fraction."""
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in x.iter(f"{_MAIN}t")) for x in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        links = {x.get("Id"): x.get("Target") for x in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = next(links[x.get(f"{_REL}id")] for x in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet") if x.get("name") == sheet)
        with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
            for _, row in ET.iterparse(f):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: dict[int, str] = {}
                for c in row.iter(f"{_MAIN}c"):
                    letters = re.match("[A-Z]+", c.get("r"))[0]
                    at = 0
                    for ch in letters:
                        at = at * 26 + ord(ch) - 64
                    value = c.find(f"{_MAIN}v")
                    if c.get("t") == "inlineStr":
                        cells[at - 1] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                    elif value is not None and value.text is not None:
                        v = shared[int(value.text)] if c.get("t") == "s" else value.text
                        cells[at - 1] = re.sub(r"^(-?\d+)\.0+$", r"\1", v) if c.get("t") in (None, "n") else v
                yield int(row.get("r")), cells
                row.clear()


class WorkbookSource(DataSource):
    """spark.read.format('workbook').option('sheet', name).load(path): row_number, and a column for each header cell.

    The first row is the header. Rows whose cells are all blank are skipped; row_number is the sheet's own number.
    Cells are text, blank for none. The path is one that the executors can open.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def _sheet(self) -> str:
        return self.options.get("sheet") or sheet_names(self.options["path"])[0]

    def schema(self) -> StructType:
        _, head = next(sheet_rows(self.options["path"], self._sheet()))
        return StructType([StructField("row_number", IntegerType()), *(StructField(head.get(i, "").strip() or f"column_{i + 1}", StringType()) for i in range(max(head, default=-1) + 1))])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self._sheet(), len(schema.fields) - 1)


class _Reader(DataSourceReader):
    def __init__(self, path: str, sheet: str, width: int):
        self.path, self.sheet, self.width = path, sheet, width

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for n, (number, cells) in enumerate(sheet_rows(self.path, self.sheet)):
            if n and any(v.strip() for v in cells.values()):
                yield (number, *(cells.get(i, "") for i in range(self.width)))
