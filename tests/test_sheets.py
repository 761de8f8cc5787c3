"""Workbooks: round trips, and a workbook with all kinds of cells put together by hand."""

import io
import zipfile

from turnloom.sources import sheets

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def by_hand():
    """Shared and rich texts, missing cells and rows, booleans, errors, a formula, dates by built-in and own formats."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(sheets.workbook({"one": [], "two <&> \"x\"": [["a"]]}))) as base, zipfile.ZipFile(out, "w") as book:
        for name in base.namelist():
            if name != "xl/worksheets/sheet1.xml":
                book.writestr(name, base.read(name))
        book.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><t>plain</t></si><si><r><t>rich </t></r><r><t>text</t></r></si></sst>")
        book.writestr("xl/styles.xml", f'<styleSheet {NS}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm &quot;d&quot;"/><numFmt numFmtId="171" formatCode="0.00 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        cells = '<row r="2"><c r="B2" t="s"><v>0</v></c><c r="D2" t="s"><v>1</v></c></row><row r="5"><c r="A5" t="b"><v>1</v></c><c r="B5" t="e"><v>#N/A</v></c><c r="C5" t="str"><f>A1</f><v>calc</v></c><c r="AB5"><v>1.5</v></c></row>'
        dates = '<row><c s="1"><v>45292.75</v></c><c s="2"><v>1</v></c><c s="3"><v>2.5</v></c><c s="0"/></row>'
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {NS}><sheetData>{cells}{dates}</sheetData></worksheet>")
    return out.getvalue()


def test_kinds_of_cells(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(by_hand())
    got = {(r.sheet, r.row): list(r.cells) for r in sheets.read_sheets(spark, f"{tmp_path}/*.xlsx").collect()}
    assert got == {
        ("one", 2): [None, "plain", None, "rich text"], ("one", 5): ["true", "#N/A", "calc"] + [None] * 24 + ["1.5"],
        ("one", 6): ["2024-01-01 18:00:00", "1899-12-31 00:00:00", "2.5", None], ('two <&> "x"', 1): ["a"],
    }


def test_round_trip(spark, tmp_path):
    rows = [("b1", "s1", 1, "x <&> ü\n", True, 1.5), ("b1", "s1", 2, None, None, None), ("b1", "s2", 3, " padded ", False, -2e300), ("b2", "s1", 4, "", True, 0.1)]
    books = sheets.workbooks(spark.createDataFrame(rows, "book string, sheet string, k long, t string, f boolean, x double"), "book", "sheet").collect()
    for b in books:
        (tmp_path / f"{b.path}.xlsx").write_bytes(b.content)
    table = sheets.read_table(spark, f"{tmp_path}/b1.xlsx", "s1").orderBy("k")
    assert table.columns == ["k", "t", "f", "x"] and [tuple(r) for r in table.collect()] == [("1", "x <&> ü\n", "true", "1.5"), ("2", None, None, None)]
    assert [tuple(r) for r in sheets.read_table(spark, f"{tmp_path}/*.xlsx", "s2").collect()] == [("3", " padded ", "false", "-2e+300")]
    assert sorted((r.path.rpartition("/")[2], r.sheet, r.row) for r in sheets.read_sheets(spark, str(tmp_path)).collect()) == [("b1.xlsx", "s1", 1), ("b1.xlsx", "s1", 2), ("b1.xlsx", "s1", 3), ("b1.xlsx", "s2", 1), ("b1.xlsx", "s2", 2), ("b2.xlsx", "s1", 1), ("b2.xlsx", "s1", 2)]
    assert [sheets.column_of(sheets.column_name(k) + "7") for k in (0, 25, 26, 701, 702)] == [0, 25, 26, 701, 702]
