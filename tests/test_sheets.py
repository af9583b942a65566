"""Spreadsheets written by hand, read through both ways."""

import zipfile

import pytest

from pulseloom.sources import corpora, sheets

HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def letters(n):
    return (letters(n // 26 - 1) if n >= 26 else "") + chr(65 + n % 26)


def book(path, rows, sheet="Sheet1", gap=0, references=True):
    """Strings are shared but for the last column, which is inline; None is no cell."""
    shared, body = [], []
    for i, row in enumerate(rows, 1 + gap):
        cells = []
        for k, v in enumerate(row):
            if v is None:
                continue
            at = f' r="{letters(k)}{i}"' if references else ""
            if isinstance(v, str) and k == len(row) - 1:
                cells.append(f'<c{at} t="inlineStr"><is><t>{v}</t></is></c>')
            elif isinstance(v, str):
                if v not in shared:
                    shared.append(v)
                cells.append(f'<c{at} t="s"><v>{shared.index(v)}</v></c>')
            else:
                cells.append(f"<c{at}><v>{v}</v></c>")
        body.append(f'<row r="{i}">{"".join(cells)}</row>')
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'{HEAD}<workbook {NS}><sheets><sheet name="Other" sheetId="1" r:id="rId2"/><sheet name="{sheet}" sheetId="2" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet7.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"{HEAD}<sst {NS}>" + "".join(f"<si><r><t>{s[:2]}</t></r><r><t>{s[2:]}</t></r></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet7.xml", f"{HEAD}<worksheet {NS}><sheetData>{''.join(body)}</sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet1.xml", f"{HEAD}<worksheet {NS}><sheetData/></worksheet>")


@pytest.fixture
def folder(tmp_path):
    book(tmp_path / "a.xlsx", [["A title of no use", None, None], ["Subject_ID", "Age", "note"], [1, 45, "ok"], [2, "old", None], [None, None, None], [3, 1e999, "x"], [4, None, "y"]], "People")
    book(tmp_path / "b.xlsx", [["Subject_ID", "Age"], [9, 30]], "People", gap=25)
    book(tmp_path / "c.xlsx", [["Subject_ID", "Age"], [7, 31]], "Others")
    (tmp_path / "d.xlsx").write_bytes(b"this is no archive")
    (tmp_path / "e.txt").write_text("not looked at")
    return tmp_path


WANT = [
    ("a.xlsx", 3, 1, 45.0, ""), ("a.xlsx", 4, 2, None, "age is not double: old"), ("a.xlsx", 6, 3, None, "age is not double: inf"), ("a.xlsx", 7, 4, None, ""),
    ("b.xlsx", None, None, None, "no header with subject_id, age in the first 20 rows"), ("c.xlsx", None, None, None, "cannot be read: ValueError: no sheet named People"), ("d.xlsx", None, None, None, "cannot be read: BadZipFile: File is not a zip file"),
]


def shown(df):
    out = sheets.typed(df, {"subject_id": "int", "age": "double"}).collect()
    return sorted(((r.path.split("/")[-1], *r[1:]) for r in out), key=lambda r: (r[0], r[1] or 0))


def test_both_ways_give_the_same_rows_and_faults(spark, folder):
    spark.dataSource.register(sheets.SheetSource)
    by_source = spark.read.format("sheet").option("needed", "subject_id, age").option("sheet", "People").load(str(folder))
    assert shown(by_source) == WANT and by_source.rdd.getNumPartitions() == 4
    assert shown(sheets.sheet_rows(spark, str(folder), ["subject_id", "age"], sheet="People")) == WANT
    wider = sheets.sheet_rows(spark, str(folder / "b.xlsx"), ["Age"], within=30, sheet="People")
    assert [(r.row_number, r.cells) for r in wider.collect()] == [(27, {"subject_id": "9", "age": "30"})]
    with pytest.raises(Exception, match="no spreadsheet"):
        spark.read.format("sheet").load(str(folder / "nothing*.xlsx")).collect()


def test_strict_stops_at_a_fault(spark, folder):
    good = sheets.typed(sheets.sheet_rows(spark, str(folder / "c.xlsx"), ["age"], sheet="Others"), {"age": "double"})
    assert [r.age for r in corpora.strict(good).collect()] == [31.0]
    with pytest.raises(Exception, match="no sheet named"):
        corpora.strict(sheets.typed(sheets.sheet_rows(spark, str(folder / "c.xlsx"), ["age"], sheet="X"), {"age": "double"})).collect()


def test_cells_without_references_and_wide_columns(tmp_path):
    book(tmp_path / "w.xlsx", [[f"c{i}" for i in range(30)], list(range(30))], references=False)
    rows = list(sheets.table_of((tmp_path / "w.xlsx").read_bytes(), ["C29"], sheet="Sheet1"))
    assert rows == [(2, {f"c{i}": str(i) for i in range(30)}, "")] and [sheets.column_of(x) for x in ("A1", "Z9", "AA1", "AB12")] == [0, 25, 26, 27]
