"""Workbooks: sheets, types, inspection, faults."""

import zipfile
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from lithic.sources import workbook as wb

NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RNS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def cell(ref, v):
    if v is None:
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, tuple):
        return f'<c r="{ref}" s="1"><v>{v[0]}</v></c>'
    if isinstance(v, (int, float)):
        return f'<c r="{ref}"><v>{v}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'


def write(path, sheets):
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{NS}" xmlns:r="{RNS}"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i + 1}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{NS}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        for i, rows in enumerate(sheets.values()):
            body = "".join(f'<row r="{r}">' + "".join(cell(f"{chr(65 + c)}{r}", v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{NS}"><sheetData>{body}</sheetData></worksheet>')
    return str(path)


@pytest.fixture
def book(tmp_path):
    return write(tmp_path / "b.xlsx", {
        "customers": [["id", "name", "name", None], [1, "Ann", "x", (45000,)], [2, "NA", "y", (45001,)], [3, "Bö", None, None]],
        "mixed": [["v", "f", "flag"], [1, 1.5, True], ["two", 2, False], [None, None, None], [" ", 3, True]],
        "empty": [],
    })


def test_sheets(spark, book):
    got = wb.sheets(spark, book)
    assert list(got) == ["customers", "mixed", "empty"]
    assert got["customers"].dtypes == [("_row_index", "bigint"), ("id", "bigint"), ("name", "string"), ("name.1", "string"), ("Unnamed: 3", "timestamp")]
    rows = [tuple(r) for r in got["customers"].orderBy("_row_index").collect()]
    assert rows[1][:4] == (1, 2, None, "y") and str(rows[0][4])[:10] == "2023-03-15"
    mixed = got["mixed"].orderBy("_row_index").collect()
    assert dict(got["mixed"].dtypes) == {"_row_index": "bigint", "v": "string", "f": "double", "flag": "boolean"}
    assert [r.v for r in mixed] == ["1", "two", None, " "] and got["empty"].count() == 0
    with pytest.raises(ValueError):
        wb.sheets(spark, book, only="nope")


def test_inspect(spark, book):
    assert [tuple(r) for r in wb.inspect(spark, book).collect()] == [("customers", 4, 4), ("mixed", 4, 3), ("empty", 0, 0)]


def test_rows_at(spark, book):
    got = wb.rows_at(wb.sheets(spark, book, "customers")["customers"], [2, 0, 9])
    assert [(r._row_index, r["Unnamed: 3"]) for r in got.collect()] == [(2, None), (0, "2023-03-15")]


def test_faults(spark, tmp_path, book):
    (tmp_path / "locked.xlsx").write_bytes(bytes.fromhex(wb.ENCRYPTED) + b"rest")
    (tmp_path / "bad.xlsx").write_bytes(b"PK nonsense")
    (tmp_path / "none.xlsx").write_bytes(b"")
    with pytest.raises(wb.PasswordProtectedError):
        wb.inspect(spark, str(tmp_path / "locked.xlsx"))
    for name in ("bad.xlsx", "none.xlsx", "missing.xlsx"):
        with pytest.raises(wb.BadWorkbookError):
            wb.inspect(spark, str(tmp_path / name))
    found = wb.files(spark, book)
    known = found.select(found.sha256.alias("file_sha256"))
    assert wb.new_files(found, known).count() == 0 and found.first().problem is None


def large(path, rows, prefix="", numbered=True):
    """A book with one large sheet of numbers and shared texts, and a second one that is damaged."""
    tag = lambda x: f"{prefix}{x}"
    at = lambda r: f' r="{r}"' if numbered else ""
    space = f'xmlns:{prefix[:-1]}="{NS}"' if prefix else f'xmlns="{NS}"'
    body = "".join(f'<{tag("row")}{at(r)}><{tag("c")}><{tag("v")}>{r}</{tag("v")}></{tag("c")}><{tag("c")} t="s"><{tag("v")}>{r % 500}</{tag("v")}></{tag("c")}></{tag("row")}>' for r in range(1, rows + 1))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{NS}" xmlns:r="{RNS}"><sheets><sheet name="a" sheetId="1" r:id="r1"/><sheet name="b" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="worksheets/b.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{NS}">' + "".join(f"<si><t>text {i}</t></si>" for i in range(500)) + "</sst>")
        z.writestr("xl/worksheets/a.xml", f'<?xml version="1.0" encoding="UTF-8"?><{tag("worksheet")} {space}><{tag("sheetData")}>{body}</{tag("sheetData")}><{tag("pageMargins")}/></{tag("worksheet")}>')
        z.writestr("xl/worksheets/b.xml", f'<worksheet xmlns="{NS}"><sheetData><row r="1"><c><v>1</v></c></row><row')
    return str(path)


@pytest.mark.parametrize("prefix, numbered", [("", True), ("x:", True), ("", False)])
def test_large_sheets_are_parsed_in_parts(spark, tmp_path, monkeypatch, prefix, numbered):
    """Parts of one sheet go to several tasks; of one wanted sheet only its own XML is read."""
    monkeypatch.setattr(wb, "PART", 10_000)
    path = large(tmp_path / "big.xlsx", 5000, prefix, numbered)
    found = wb.cells(spark, path, "a").where("sheet IS NOT NULL")
    got = {(r.row, r.col): r.value for r in found.collect()}
    assert got == {(r, c): str(r) if c == 1 else f"text {r % 500}" for r in range(1, 5001) for c in (1, 2)}
    parts = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(wb._split("cells", "a"), wb.PARTS).where("part IS NOT NULL")
    assert parts.count() > 20
    dealt = parts.repartition(4, "path", "sheet_index", "first").mapInPandas(wb._parse, wb.CELLS).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(dealt) == 4 and max(r["count"] for r in dealt) < 0.6 * 10_000
    with pytest.raises(wb.BadWorkbookError):
        wb.sheets(spark, path)
    assert wb.sheets(spark, path, "a")["a"].count() == 4999


def test_a_missing_shared_text_is_an_error(spark, tmp_path):
    path = large(tmp_path / "short.xlsx", 3)
    with zipfile.ZipFile(path) as z:
        names = {n: z.read(n) for n in z.namelist()}
    with zipfile.ZipFile(tmp_path / "cut.xlsx", "w") as z:
        for n, data in names.items():
            z.writestr(n, data.replace(b"<si><t>text 2</t></si>", b"")[: None if "shared" not in n else 200] if "shared" in n else data)
    with pytest.raises(wb.BadWorkbookError, match="no shared text"):
        wb.sheets(spark, str(tmp_path / "cut.xlsx"), "a")
