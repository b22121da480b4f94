import csv
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tallymark.sources import workbook
from tallymark.sources.scan import find_separator, mended, read_any, repaired, sample_sales, scan, write_csv


def _file(tmp_path, text, encoding="utf-8"):
    p = tmp_path / "in.csv"
    p.write_bytes(text.encode(encoding))
    return str(p)


def test_scan_of_a_messy_file(spark, tmp_path):
    df, report = scan(spark, _file(tmp_path, "Export du jour;;\nDate;Montant;Montant\n04/10/2023;1,5;a\n05/10/2023;2,5\n06/10/2023;3;b;too;many\n07/10/2023;;c\n"))
    assert (report.separator, report.header_row, report.columns) == (";", 1, ["Date", "Montant", "Montant_2"])
    assert sorted(map(tuple, df.collect())) == [("04/10/2023", "1,5", "a"), ("05/10/2023", "2,5", None), ("07/10/2023", None, "c")]


def test_scan_of_western_encoding(spark, tmp_path):
    df, report = scan(spark, _file(tmp_path, "ville,prix\nThiès,1€\nOrléans,2€\n", "cp1252"))
    assert report.encoding == "windows-1252" and {(r.ville, r.prix) for r in df.collect()} == {("Thiès", "1€"), ("Orléans", "2€")}


def test_empty_file(spark, tmp_path):
    with pytest.raises(ValueError, match="B04"):
        scan(spark, _file(tmp_path, "\n"))


def test_names():
    assert repaired(["x", "x", "", "Unnamed: 3"]) == ["x", "x_2", "colonne_3", "colonne_4"]
    assert find_separator(["a|b|c", "1|2,5|3"]) == "|"


def test_generated_sales_round_trip(spark, tmp_path):
    write_csv(sample_sales(spark, 300), f"{tmp_path}/out")
    df, _ = scan(spark, f"{tmp_path}/out")
    assert df.count() == 300 and df.columns[-1] == "montant"


@pytest.mark.parametrize(("seed", "encoding", "sep", "end"), [(1, "utf-8", ",", "\n"), (2, "utf-8", ";", "\r\n"), (3, "cp1252", ",", "\n"), (4, "utf-8", ",", "\n")])
def test_line_breaks_in_cells_by_blocks(spark, tmp_path, seed, encoding, sep, end):
    """Random quoting, read in blocks of some hundred bytes, is what the csv module wrote."""
    rnd = random.Random(seed)
    bits = ["a", "é", "x y", '"', '""', ",", ";", "\n", "\n\n", "1", " ", "|"]
    rows = [["k" + str(k), *["".join(rnd.choice(bits) for _ in range(rnd.randrange(6 if k % 40 else 120))) for _ in range(2)]] for k in range(400)]
    rows = [[x if x.strip() else "z" for x in r] for r in rows]
    text = io.StringIO()
    csv.writer(text, delimiter=sep, lineterminator=end).writerows([["key", "first", "second"], *rows])
    path = _file(tmp_path, text.getvalue(), encoding)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        df, report = scan(spark, path)
        got = sorted(map(tuple, df.collect()))
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert report.line_breaks_in_cells and report.separator == sep
    trimmed = lambda rs: sorted(tuple(x.strip(" ") for x in r) for r in rs)
    assert trimmed(got) == trimmed(rows)


def test_an_open_quote_and_pipes_of_inches(spark, tmp_path):
    """A quote inside an unquoted cell opens nothing, and lines after it are read as ever."""
    df, report = scan(spark, _file(tmp_path, 'id,size\n1,5" pipe\n2,"two\nlines"\n3,7" pipe\n4,"a ""b"" c"\n'))
    assert report.line_breaks_in_cells
    assert sorted(map(tuple, df.collect())) == [("1", '5" pipe'), ("2", "two\nlines"), ("3", '7" pipe'), ("4", 'a "b" c')]


def test_damaged_accents_and_wide_encodings(spark, tmp_path):
    df, report = scan(spark, _file(tmp_path, "ville,n\nParisÃ©,1\nThiès,2\nl’Ã©tÃ©,3\n"))
    assert report.encoding == "UTF-8" and report.damaged_accents and report.notes == ["S01_encoding"]
    # What isn't damaged as a whole is left: its bytes are no UTF-8.
    assert {r.n: r.v for r in df.select("n", mended(F.col("ville")).alias("v")).collect()} == {"1": "Parisé", "2": "Thiès", "3": "l’Ã©tÃ©"}
    for name in ("utf-16-le", "utf-16-be"):
        df, report = scan(spark, _file(tmp_path, "\ufeffville;n\nThiès;1\nOrléans;2\n", name))
        assert report.encoding == name.upper().replace("UTF-16-", "UTF-16") and df.columns == ["ville", "n"] and sorted(map(tuple, df.collect())) == [("Orléans", "2"), ("Thiès", "1")]


def _workbook(**parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), body)
    return out.getvalue()


def test_workbook(spark):
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f"""<worksheet {space}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>note</t></is></c></row>
      <row r="2"><c r="A2" s="1"><v>45203</v></c><c r="B2"><v>12.50</v></c><c r="D2" t="b"><v>1</v></c></row><row r="3"/>
      <row r="4"><c r="A4" s="2"><v>45204.5</v></c><c r="B4"><v>7</v></c><c r="D4" t="str"><v>x &amp; y</v></c></row></sheetData></worksheet>"""
    book = _workbook(
        xl__workbook_xml=f'<workbook {space} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="s" sheetId="1" r:id="rId7"/></sheets></workbook>',
        xl___rels__workbook_xml="", xl__worksheets__one_xml=sheet, xl__sharedStrings_xml=f"<sst {space}><si><t>date</t></si><si><r><t>mon</t></r><r><t>tant</t></r></si></sst>",
        xl__styles_xml=f'<styleSheet {space}><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>',
    )
    fixed = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(book)) as old, zipfile.ZipFile(fixed, "w") as new:
        for n in old.namelist():
            if "rels" not in n:
                new.writestr(n, old.read(n))
        new.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Target="worksheets/one.xml"/></Relationships>')
    df, report = read_any(spark, fixed.getvalue(), "sales.XLSX")
    assert report.columns == ["date", "montant", "colonne_3", "note"]
    assert sorted(map(tuple, df.collect())) == [("2023-10-04 00:00:00", "12.5", None, "True"), ("2023-10-05 12:00:00", "7", None, "x & y")]
    with pytest.raises(ValueError, match="zipped XML"):
        workbook.rows(b"no zip")


def test_benchmark_over_volumes(spark):
    from tallymark.operators.profile import benchmark

    got = benchmark(spark, [200, 500]).collect()
    assert [(r.operation, r.n_rows) for r in got] == [(o, n) for n in (200, 500) for o in ("read", "profile", "aggregate")]
    assert all(r.seconds > 0 for r in got) and [r.n_out for r in got if r.operation == "read"] == [200, 500] and [r.n_out for r in got if r.operation == "profile"] == [8, 8]
