import json
import zipfile

import pytest

from caudal.sources.excel import named
from caudal.sources.files import read_files

HEAD = '<?xml version="1.0"?>'
SPACE = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
LINK = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(path, *sheets, texts=(), date1904=False):
    """A workbook of sheets given as (name, rows in XML)."""
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w") as out:
        listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, (n, _) in enumerate(sheets, 1))
        out.writestr("xl/workbook.xml", f'{HEAD}<workbook {SPACE} {LINK}><workbookPr date1904="{int(date1904)}"/><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1))
        out.writestr("xl/_rels/workbook.xml.rels", f"{HEAD}<Relationships>{links}</Relationships>")
        out.writestr("xl/sharedStrings.xml", f"{HEAD}<sst {SPACE}>" + "".join(f"<si>{t}</si>" for t in texts) + "</sst>")
        out.writestr("xl/styles.xml", f'{HEAD}<styleSheet {SPACE}><numFmts><numFmt numFmtId="170" formatCode="yyyy&quot;x&quot;-mm"/>'
                     '<numFmt numFmtId="171" formatCode="0.00&quot;days&quot;"/></numFmts>'
                     '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        for i, (_, rows) in enumerate(sheets, 1):
            out.writestr(f"xl/worksheets/s{i}.xml", f"{HEAD}<worksheet {SPACE}><sheetData>{rows}</sheetData></worksheet>")


def inline(*values):
    return "<row>" + "".join(f'<c t="inlineStr"><is><t>{v}</t></is></c>' for v in values) + "</row>"


def test_values_of_all_kinds(spark, tmp_path):
    rows = ('<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c><c r="D2" t="inlineStr"><is><t>flag</t></is></c></row>'
            '<row r="3"><c r="A3"><v>7.0</v></c><c r="B3" s="1"><v>45292</v></c><c r="D3" t="b"><v>1</v></c></row><row r="4"/>'
            '<row r="5"><c r="A5"><v>0.125</v></c><c r="B5" s="2"><v>45292.5</v></c><c r="D5" t="e"><v>#N/A</v></c><c r="F5" t="str"><v>more</v></c></row>'
            '<row r="6"><c r="B6" s="3"><v>1.5</v></c><c r="C6" t="inlineStr"><is><r><t>two </t></r><r><t>runs</t></r></is></c></row>')
    workbook(tmp_path / "w" / "a.xlsx", ("One", rows), texts=["<t>n</t>", "<r><t>da</t></r><r><t>y</t></r><rPh><t>hint</t></rPh>"])
    df = read_files(spark, str(tmp_path / "w"), "xlsx")
    assert df.columns == ["n", "day", "#3", "flag", "_rescued_data"]
    found = [tuple(r) for r in df.collect()]
    assert [r[:4] for r in found] == [("7", "2024-01-01", None, "true"), ("0.125", "2024-01-01 12:00:00", None, "#N/A"), (None, "1.5", "two runs", None)]
    assert json.loads(found[1][4])["#6"] == "more" and found[0][4] is None


def test_columns_by_name_sheets_and_damaged_files(spark, tmp_path):
    workbook(tmp_path / "w" / "a.xlsx", ("One", inline("x")), ("Two", inline("id", "v") + inline("1", "a")))
    workbook(tmp_path / "w" / "b.xlsx", ("Other", ""), ("Two", inline("v", "id", "w") + inline("b", "2", "c") * 3))
    (tmp_path / "w" / "c.xlsx").write_bytes(b"no workbook")
    df = read_files(spark, str(tmp_path / "w"), "xlsx", schema="id string, v string, _rescued_data string", sheet="Two")
    found = sorted(map(tuple, df.collect()), key=repr)
    assert [r[:2] for r in found] == [("1", "a")] + [("2", "b")] * 3 + [(None, None)]
    assert all(json.loads(r[2])["w"] == "c" for r in found[1:4]) and json.loads(found[4][2])["_error"]
    assert read_files(spark, str(tmp_path / "w" / "a.xlsx"), "xlsx", sheet="2").count() == 1
    assert read_files(spark, str(tmp_path / "w" / "a.xlsx"), "xlsx").count() == 0
    with pytest.raises(Exception, match="as text"):
        read_files(spark, str(tmp_path / "w"), "xlsx", schema="id int").collect()


def test_dates_from_1904_and_names(spark, tmp_path):
    rows = inline("d") + '<row><c s="1"><v>1</v></c></row>'
    workbook(tmp_path / "a.xlsx", ("One", rows), date1904=True)
    assert read_files(spark, str(tmp_path / "a.xlsx"), "xlsx").first()["d"] == "1904-01-02"
    assert named(["a", None, "a", " b "]) == ["a", "#2", "a#3", "b"]
