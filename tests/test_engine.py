"""Formulas, recalculation, graph operators, files and queries."""

import duckdb
import pytest

import __spark_entry__ as driver
from sheafcalc.functions import aggregates as A
from sheafcalc.operators import graph
from sheafcalc.operators.cells import make_cells
from sheafcalc.operators.recalc import recalculated, self_check
from sheafcalc.plans import formula as fx
from sheafcalc.sources import xlsx

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("text", ["=SUM(", '="unterminated', "=@@@", "={1,2}", "=A1048577", "=1 2"])
def test_malformed(text):
    with pytest.raises(fx.FormulaError):
        fx.parse(text)


@pytest.mark.parametrize("text", ["=1+2*3", "=(1+2)*3", "=-2^2", "='Odd Sheet'!$B$2:C9%", '=IF(A1>"x",,2)&"q"', "=SUM(Sales[Amount])", "=1-(2-3)"])
def test_text_round_trip(text):
    assert fx.parse("=" + fx.shown(fx.parse(text))) == fx.parse(text)


def test_signature_and_move():
    left, right = fx.parse("=B1*$A$1"), fx.parse("=C1*$A$1")
    assert fx.signature(left, 3, 1) == fx.signature(right, 4, 1)
    assert fx.moved(left, 1, 0) == right


@pytest.fixture(scope="module")
def computed(spark):
    rows = {"A1": 10, "A2": 20, "A3": "x", "A4": True, "B1": ("=SUM(A1:A4)", 30), "B2": ("=B1*2-A1", 51), "B3": '=IFERROR(1/A9,"none")', "C1": "=VLOOKUP(20,A1:B2,2,FALSE)", "C2": '=SUMIF(A1:A3,">15")', "C3": "=COUNTBLANK(A1:A6)", "D1": "=A1/0", "D2": "=D1+1", "E1": "=F1", "F1": "=E1", "E2": "=E1+1", "D3": '=A3&"-"&A1', "D4": "=INDEX(A1:A3,2)", "D5": "=MATCH(20,A1:A3,0)", "D6": "=SUMPRODUCT(A1:A2,A1:A2)", "D7": "=-2^2", "D8": "=FOO(1)", "D9": "=IF(A1>5,A2,0)", "G1": "=SUM(", "H1": "=H1+1", "I1": "=AVERAGE(A1:A2)", "I2": "=MEDIAN(A1:A2,3)", "I3": "=STDEV(A1)", "I4": "=AND(A1>5,A4)", "I5": '=COUNTIF(A1:A4,"x")', "I6": '=SUMIFS(A1:A2,A1:A2,">5",A1:A2,"<15")', "I7": "=LARGE(A1:A2,2)", "I8": "=LEFT(A3&\"yz\",2)", "I9": "=ROUND(2.675,2)", "J1": "=MOD(-3,5)", "J2": "=SQRT(-1)", "J3": "=5%+1", "J4": '="a"<1', "J5": "=ISERR(D1)",
        "K1": '=IFS(A1>50,"a",A1>5,"b")', "K2": '=SWITCH(A1,10,"ten","other")', "K3": '=CHOOSE(2,"x","y")', "K4": "=HLOOKUP(10,A1:B2,2,FALSE)", "K5": '=XLOOKUP(15,A1:A2,B1:B2,"none",-1)', "K6": '=TEXTJOIN("-",TRUE,A1:A3)', "K7": '=SUBSTITUTE("banana","a","o",2)', "K8": '=FIND("n","banana",4)', "K9": "=NPV(0.1,A1:A2)",
        "L1": '=REPLACE("abcdef",2,2,"ZZ")', "L2": "=DATE(2026,3,15)", "L3": "=YEAR(EDATE(L2,12))", "L4": "=EOMONTH(L2,0)-L2", "L5": '=DATEDIF(L2,EDATE(L2,14),"M")', "L6": "=WEEKDAY(L2,2)", "L7": "=ROUNDUP(2.121,2)", "L8": '=TEXT(1234.5,"#,##0.00")', "L9": "=HOUR(0.75)", "M1": '=IFS(A1>50,"a")', "M2": '=SUBSTITUTE("banana","an","")',
        "N1": "=SUM(A:A)", "N2": "=ROUND(1.005,2)", "N3": "=INDEX(A1:B2,2)", "N4": "=INDEX(A1:A9,7)", "N5": "=INDEX(A1:A3,4)", "N6": '=SUMIF(A1:A2,">="&A2)', "N7": "=VLOOKUP(20,A1:B2,3,FALSE)", "N8": '=IF("maybe",1,2)', "N9": "=CEILING(2.1)",
        "O1": "=SUMPRODUCT(A1:A2,A1:A3)", "O2": '=REPT("a",-1)', "O3": "=Nowhere!A1+1", "O4": "=PMT(0,10,100,50)", "O5": "=SUM(1:1)*0+ROUNDUP(2.1,A9)", "O6": '=AND(TRUE,"no")', "O7": '=LEFT("abc",-1)', "O8": "=SUM($P$1:$P$3)", "O9": "=MATCH(25,P1:P3,-1)", "P1": 40, "P2": 30, "P3": 20, "Q1": "=VLOOKUP(35,R1:S4,2)", "R1": 10, "R2": 30, "R3": 90, "R4": 31, "S1": 1, "S2": 2, "S3": 3, "S4": 4}
    cells = make_cells(spark, rows)
    values = recalculated(cells)
    return cells, values, {f"{fx.column_letters(r.col)}{r.row}": next((x for x in r.value if x is not None), None) for r in values.collect()}


@pytest.mark.parametrize("cell, want", [("B1", 30), ("B2", 50), ("B3", "none"), ("C1", 50), ("C2", 20), ("C3", 2), ("D1", "#DIV/0!"), ("D2", "#DIV/0!"), ("E1", "#CIRC!"), ("E2", "#CIRC!"), ("D3", "x-10"), ("D4", 20), ("D5", 2), ("D6", 500), ("D7", 4), ("D8", "#NAME?"), ("D9", 20), ("G1", "#NAME?"), ("H1", "#CIRC!"), ("I1", 15), ("I2", 10), ("I3", "#DIV/0!"), ("I4", True), ("I5", 1), ("I6", 10), ("I7", 10), ("I8", "xy"), ("I9", 2.68), ("J1", 2), ("J2", "#NUM!"), ("J3", 1.05), ("J4", False), ("J5", True), ("K1", "b"), ("K2", "ten"), ("K3", "y"), ("K4", 20), ("K5", 30), ("K6", "10-20-x"), ("K7", "banona"), ("K8", 5), ("K9", 10 / 1.1 + 20 / 1.1**2), ("L1", "aZZdef"), ("L2", 46096), ("L3", 2027), ("L4", 16), ("L5", 14), ("L6", 7), ("L7", 2.13), ("L8", "1,234.50"), ("L9", 18), ("M1", "#N/A"), ("M2", "ba"), ("N1", 30), ("N2", 1.01), ("N3", 20), ("N4", None), ("N5", "#REF!"), ("N6", 20), ("N7", "#REF!"), ("N8", "#VALUE!"), ("N9", 3), ("O1", "#VALUE!"), ("O2", "#VALUE!"), ("O3", "#REF!"), ("O4", -15), ("O6", "#VALUE!"), ("O7", "#VALUE!"), ("O8", 90), ("O9", 2), ("Q1", 2)])
def test_value(computed, cell, want):
    assert computed[2][cell] == want


def test_self_check(computed):
    assert {(r.col, r.row): r.matched for r in self_check(*computed[:2]).collect()} == {(2, 1): True, (2, 2): False}


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (5, 6), (6, 5), (6, 7), (8, 8)], "src int, dst int")
    nodes = spark.range(1, 9).selectExpr("cast(id as int) as node")
    done, held = graph.levels(e, nodes)
    assert {r.node: r.level for r in done.collect()} == {1: 0, 2: 1, 3: 2, 4: 3}
    assert {r.node for r in held.collect()} == {5, 6, 7, 8}
    assert {(r.node, r.component) for r in graph.cycles(e).collect()} == {(5, 5), (6, 5), (8, 8)}
    start = spark.createDataFrame([(2,)], "node int")
    assert {(r.node, r.depth) for r in graph.downstream(e, start).collect()} == {(2, 0), (3, 1), (4, 2)}
    assert {(r.node, r.depth) for r in graph.trace(e, spark.createDataFrame([(4,)], "node int")).collect()} == {(4, 0), (3, 1), (1, 2), (2, 2)}


def test_criteria(spark):
    x = spark.createDataFrame([("North",), ("south",), (None,), ("nth",)], "s string")
    count = lambda crit: x.agg(A.countif(A.matches(x.s, crit, True)).alias("n")).first().n
    assert [count(c) for c in ("north", "n*th", "<>north", "", "?th", ">n")] == [1, 2, 3, 1, 1, 3]


def test_files(spark, tmp_path):
    raw = xlsx.file_of({"Data": {"A1": 1.5, "A2": "a<b", "A3": True}, "Odd Sheet": {"B2": "=SUM(Data!A1:A2)*2"}})
    (tmp_path / "m.xlsx").write_bytes(raw)
    (tmp_path / "n.xlsx").write_bytes(b"no zip")
    cells = xlsx.read_files(spark, f"file://{tmp_path}")
    got = {(r.sheet, r.col, r.row): r for r in cells.collect()}
    assert got["Data", 1, 1].n == 1.5 and got["Data", 1, 2].s == "a<b" and got["Data", 1, 3].b is True and got["Odd Sheet", 2, 2].formula == "=SUM(Data!A1:A2)*2"
    assert {r.value.n for r in recalculated(cells).collect()} >= {3.0}
    fixed = xlsx.corrected(raw, {("Odd Sheet", 2, 2): "=SUM(Data!A1:A3)*2"})
    assert ("=SUM(Data!A1:A3)*2" in [c[4] for c in xlsx.cells_of("m", fixed)]) and b"A1:A3" not in raw


NAMES = sorted(n for n in driver.queries() if n.split("_")[0] in ("cells", "fn", "op", "graph", "rule", "audit", "guard", "history", "grid", "join", "window", "setop"))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    """At the smallest scale every query gives the rows that its SQL gives."""
    got = driver.queries()[name](spark, SMALL)
    rows = sorted(map(repr, (tuple(r[c] for c in sorted(got.columns)) for r in got.collect())))
    if name in driver.oracle_sql():
        con = duckdb.connect()
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
        want = con.sql(driver.oracle_sql()[name])
        at = [want.columns.index(c) for c in sorted(want.columns)]
        assert sorted(want.columns) == sorted(got.columns)
        assert rows == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_filled_formulas_formats_and_hidden_lines_of_files(spark, tmp_path):
    import io
    import zipfile

    sheet = '<cols><col min="3" max="4" hidden="1"/></cols><sheetData><row r="1"><c r="A1" s="1"><v>2</v></c><c r="B1"><f t="shared" ref="B1:B3" si="0">A1*$A$1+SUM(A:A)&amp;"A1"</f><v>4</v></c></row><row r="2" hidden="1"><c r="A2" s="2"><v>3</v></c><c r="B2"><f t="shared" si="0"/><v>6</v></c></row></sheetData>'
    styles = '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts><numFmt numFmtId="164" formatCode="0.0 \u20ac"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="7"/></cellXfs></styleSheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(xlsx.file_of({"S": {"A1": 1}}))) as z, zipfile.ZipFile(out, "w") as to:
        for item in z.infolist():
            raw = z.read(item).decode()
            to.writestr(item, raw.replace(raw[raw.index("<sheetData>") : raw.index("</sheetData>") + 12], sheet) if "sheet1" in item.filename else raw)
        to.writestr("xl/styles.xml", styles)
    (tmp_path / "f.xlsx").write_bytes(out.getvalue())
    got = {(r.col, r.row): r for r in xlsx.read_files(spark, f"file://{tmp_path}").collect()}
    assert got[2, 2].formula == '=A2*$A$1+SUM(A:A)&"A1"' and got[2, 2].cn == 6 and got[2, 2].n is None
    assert got[1, 1].number_format == "0.0 \u20ac" and "$" in got[1, 2].number_format and got[2, 1].number_format == "General"
    assert {(r.axis, r.line) for r in xlsx.read_hidden(spark, f"file://{tmp_path}").collect()} == {("row", 2), ("col", 3), ("col", 4)}
    fixed = xlsx.corrected(out.getvalue(), {("S", 2, 1): "=A1"})
    assert {c[2:5] for c in xlsx.cells_of("f", fixed) if c[4]} == {(2, 1, "=A1"), (2, 2, '=A2*$A$1+SUM(A:A)&"A1"')}
    assert xlsx.shifted("SUM('A1'!B2:$C3,LOG10(D$4),X.A1,2:3)", 1, -1) == "SUM('A1'!C1:$C2,LOG10(E$4),X.A1,1:2)"
    assert xlsx.shifted("A1+B2", -1, 0) == "#REF!+A2"


def test_names_and_tables(spark, tmp_path):
    """Defined names, names within names, table columns and a circle of names, from a file."""
    import io
    import zipfile

    raw = xlsx.file_of({"My Data": {"A1": "Region", "B1": "Amount", "A2": "North", "B2": 100, "A3": "South", "B3": 250, "A4": "North", "B4": 400, "A5": "Total", "B5": 1, "D1": "=SUM(Sales[Amount])", "D2": '=SUMIFS(Sales[Amount],Sales[Region],"North")', "D3": "=SUM(sales[[#Data],[amount]])*Rate", "D4": "=Twice+1", "D5": "=Loop", "D6": "=Unknown+1", "D7": "=COUNTA(Sales[])", "E1": 0.5}})
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    names = "".join(f'<definedName name="{k}">{v}</definedName>' for k, v in {"Rate": "'My Data'!$E$1", "Twice": "Rate*2+SUM(Sales[Amount])", "Loop": "Back+1", "Back": "Loop*2", "_xlnm.Print_Area": "A1"}.items())
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(raw)) as z, zipfile.ZipFile(out, "w") as to:
        for item in z.infolist():
            part = z.read(item).decode()
            to.writestr(item, part.replace("</sheets>", f"</sheets><definedNames>{names}</definedNames>") if item.filename == "xl/workbook.xml" else part)
        to.writestr("xl/worksheets/_rels/sheet1.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/table" Target="../tables/table1.xml"/></Relationships>')
        to.writestr("xl/tables/table1.xml", f'<table {main} id="1" displayName="Sales" ref="A1:B5" totalsRowCount="1"><tableColumns count="2"><tableColumn id="1" name="Region"/><tableColumn id="2" name="Amount"/></tableColumns></table>')
    (tmp_path / "t.xlsx").write_bytes(out.getvalue())
    bad = io.BytesIO()
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("a.txt", "no workbook")
    (tmp_path / "bad.xlsx").write_bytes(bad.getvalue())
    (tmp_path / "text.xlsx").write_bytes(b"plain text")
    (tmp_path / "old.xls").write_bytes(b"PK")
    path = f"file://{tmp_path}"
    known = xlsx.read_names(spark, path)
    assert {(r.name, r.target) for r in known.collect() if "[" in r.name} == {("Sales[Region]", "'My Data'!A2:A4"), ("Sales[Amount]", "'My Data'!B2:B4"), ("Sales[]", "'My Data'!A2:B4")}
    cells = xlsx.read_files(spark, path)
    got = {r.row: r.value for r in recalculated(cells, names=known).filter("col = 4").collect()}
    assert [got[k].n for k in (1, 2, 3, 4, 7)] == [750, 500, 375, 752, 6] and got[5].e == got[6].e == "#NAME?"
    from sheafcalc.operators.cells import parsed

    assert ["LOOP > BACK > LOOP" in r.parse_error for r in parsed(cells, known).filter("parse_error IS NOT NULL").collect()] == [True]
    assert {r.workbook_id.rsplit("/", 1)[1]: r.reason.split(":")[0] for r in xlsx.read_rejected(spark, path).collect()} == {"bad.xlsx": "KeyError", "text.xlsx": "no zip file", "old.xls": "not named .xlsx"}
