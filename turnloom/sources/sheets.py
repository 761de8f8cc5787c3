"""Spreadsheets: workbooks of zipped XML, read a sheet to a task from any file system that Spark reads, and written from rows."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: name spaces, built-in number formats that are dates or times, the day that serial numbers count from.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DATES = {*range(14, 23), *range(45, 48)}
DAY_0 = datetime(1899, 12, 30)
#: Rows of a sheet at most.
MOST_ROWS = 1_048_576


def column_of(place: str) -> int:
    """0 for A5, 27 for AB1."""
    n = 0
    for letter in re.match(r"[A-Z]+", place)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def column_name(k: int) -> str:
    name = ""
    while k >= 0:
        name, k = chr(65 + k % 26) + name, k // 26 - 1
    return name


def sheet_parts(book: zipfile.ZipFile) -> dict[str, str]:
    """The part of each sheet by its name, in the workbook's order."""
    links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")
    return {x.get("name"): (t[1:] if (t := links[x.get(LINK)]).startswith("/") else f"xl/{t}") for x in sheets}


def texts_of(item: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in item.iter(f"{MAIN}t"))


def date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a date or a time."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    styles = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in styles.iter(f"{MAIN}numFmt") if re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", "")), re.IGNORECASE)}
    formats = styles.find(f"{MAIN}cellXfs")
    return {k for k, x in enumerate(formats if formats is not None else ()) if int(x.get("numFmtId", 0)) in DATES | own}


def value_of(cell: ElementTree.Element, shared: list[str], dates: set[int]) -> str | None:
    """A cell as text: numbers as written, booleans as true and false, dates as ISO times."""
    kind, found = cell.get("t", "n"), cell.find(f"{MAIN}v")
    if kind == "inlineStr":
        return texts_of(cell)
    if found is None or found.text is None:
        return None
    if kind == "s":
        return shared[int(found.text)]
    if kind == "b":
        return "true" if found.text == "1" else "false"
    if kind == "n" and int(cell.get("s", 0)) in dates:
        return (DAY_0 + timedelta(microseconds=round(float(found.text) * 86_400_000_000))).isoformat(sep=" ")
    return found.text


def rows_of(content: bytes, sheet: str) -> Iterator[tuple[int, list[str | None]]]:
    """(row from 1, cells) of one sheet; the XML is read as a stream and dropped row by row."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = [texts_of(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")] if "xl/sharedStrings.xml" in book.namelist() else []
        dates, last = date_styles(book), 0
        with book.open(sheet_parts(book)[sheet]) as part:
            for _, row in ElementTree.iterparse(part):
                if row.tag != f"{MAIN}row":
                    continue
                last = int(row.get("r", last + 1))
                cells: list[str | None] = []
                for cell in row.iter(f"{MAIN}c"):
                    at = column_of(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (at - len(cells)) + [value_of(cell, shared, dates)]
                yield last, cells
                row.clear()


def workbook_rows(books: DataFrame, sheet: str | None = None) -> DataFrame:
    """path, sheet, row, cells of all sheets (or one) of workbooks in columns path and content.

    Workbooks are listed first; then each sheet is a row of its own and dealt
    anew, so the sheets of one workbook are read side by side. The format bounds
    a sheet at 1,048,576 rows, and a workbook is one value: each is a task's.
    """

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            named = [(p, s, c) for p, c in zip(pdf["path"], pdf["content"]) for s in sheet_parts(zipfile.ZipFile(io.BytesIO(c))) if sheet in (None, s)]
            yield pd.DataFrame(named, columns=["path", "sheet", "content"])

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, name, content in zip(pdf["path"], pdf["sheet"], pdf["content"]):
                block: list[tuple] = []
                for row, cells in rows_of(content, name):
                    block.append((path, name, row, cells))
                    if len(block) == 5000:
                        yield pd.DataFrame(block, columns=["path", "sheet", "row", "cells"])
                        block = []
                yield pd.DataFrame(block, columns=["path", "sheet", "row", "cells"])

    sheets = books.select("path", "content").mapInPandas(listed, "path string, sheet string, content binary")
    return sheets.repartition("path", "sheet").mapInPandas(read, "path string, sheet string, row long, cells array<string>")


def read_sheets(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """``workbook_rows`` of the files of a path or pattern."""
    return workbook_rows(spark.read.format("binaryFile").load(path), sheet)


def read_table(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """One sheet as a table of texts: the first row of the first file names the columns, rows without cells are passed over."""
    rows = read_sheets(spark, path, sheet)
    head = rows.orderBy("path", "row").select("cells").first()
    names = [x or f"_c{k}" for k, x in enumerate(head["cells"])] if head else []
    body = rows.filter((F.col("row") > 1) & F.exists("cells", lambda x: x.isNotNull()))
    return body.select(*(F.get("cells", k).alias(name) for k, name in enumerate(names)))


def cell_xml(at: str, value: object) -> str:
    if value is None or (isinstance(value, float) and value != value):
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{at}"><v>{value!r}</v></c>'
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def workbook(sheets: dict[str, list[list]]) -> bytes:
    """A workbook of the sheets' rows, with texts in their cells."""
    head, ns = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>', MAIN[1:-1]
    office = LINK[1:-3]
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kinds}.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
        book.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/>{parts}</Types>')
        links = "http://schemas.openxmlformats.org/package/2006/relationships"
        book.writestr("_rels/.rels", f'{head}<Relationships xmlns="{links}"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{ns}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{escape(name, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, name in enumerate(sheets, 1)) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{links}">' + "".join(f'<Relationship Id="rId{k}" Type="{office}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        for k, rows in enumerate(sheets.values(), 1):
            if len(rows) > MOST_ROWS:
                raise ValueError(f"a sheet holds {MOST_ROWS} rows at most")
            body = "".join(f'<row r="{n}">' + "".join(cell_xml(f"{column_name(i)}{n}", v) for i, v in enumerate(row)) + "</row>" for n, row in enumerate(rows, 1))
            book.writestr(f"xl/worksheets/sheet{k}.xml", f'{head}<worksheet xmlns="{ns}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def workbooks(rows: DataFrame, book: str, sheet: str) -> DataFrame:
    """path, content: a workbook for each value of ``book`` with a sheet for each value of ``sheet``, a header and the other columns' rows in their order.

    A book is made in one task; ``book`` should bound its rows, as the format does.
    """
    columns = [c for c in rows.columns if c not in (book, sheet)]

    def made(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values([sheet, *columns])
        parts = {str(name): [columns, *([None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r] for r in part[columns].itertuples(index=False))] for name, part in ordered.groupby(sheet, sort=True)}
        return pd.DataFrame({"path": [str(key[0])], "content": [workbook(parts)]})

    return rows.groupBy(book).applyInPandas(made, "path string, content binary")
