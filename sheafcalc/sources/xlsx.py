"""Workbook files (zipped XML) as cells, and corrected copies."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafcalc.operators.cells import SCHEMA
from sheafcalc.plans.formula import column_letters, column_number, reference

#: Names of the file format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Larger files are turned away.
MOST_BYTES = 15 << 20
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]
HIDDEN = "workbook_id string, sheet string, axis string, line int"
#: Number formats that files name by number only.
FORMATS = {
    1: '0',
    2: '0.00',
    3: '#,##0',
    4: '#,##0.00',
    5: '"$"#,##0_);\\("$"#,##0\\)',
    6: '"$"#,##0_);[Red]\\("$"#,##0\\)',
    7: '"$"#,##0.00_);\\("$"#,##0.00\\)',
    8: '"$"#,##0.00_);[Red]\\("$"#,##0.00\\)',
    9: '0%',
    10: '0.00%',
    11: '0.00E+00',
    12: '# ?/?',
    13: '# ??/??',
    14: 'mm-dd-yy',
    15: 'd-mmm-yy',
    16: 'd-mmm',
    17: 'mmm-yy',
    18: 'h:mm AM/PM',
    19: 'h:mm:ss AM/PM',
    20: 'h:mm',
    21: 'h:mm:ss',
    22: 'm/d/yy h:mm',
    37: '#,##0_);(#,##0)',
    38: '#,##0_);[Red](#,##0)',
    39: '#,##0.00_);(#,##0.00)',
    40: '#,##0.00_);[Red](#,##0.00)',
    41: '_(* #,##0_);_(* \\(#,##0\\);_(* "-"_);_(@_)',
    42: '_("$"* #,##0_);_("$"* \\(#,##0\\);_("$"* "-"_);_(@_)',
    43: '_(* #,##0.00_);_(* \\(#,##0.00\\);_(* "-"??_);_(@_)',
    44: '_("$"* #,##0.00_);_("$"* \\(#,##0.00\\);_("$"* "-"??_);_(@_)',
    45: 'mm:ss',
    46: '[h]:mm:ss',
    47: 'mmss.0',
    48: '##0.0E+0',
    49: '@',
}
#: Texts and quoted sheets, which stay; names, functions and sheets, which stay; references: cells, columns, rows.
SHIFTED = re.compile(r"""("(?:[^"]|"")*"|'(?:[^']|'')*'|\[[^\]]*\])|(?<![\w.$])(?:(\$?)([A-Za-z]{1,3})(\$?)(\d+)|(\$?)([A-Za-z]{1,3}):(\$?)([A-Za-z]{1,3})|(\$?)(\d+):(\$?)(\d+))(?![\w.(!])""")


def shifted(formula: str, cols: int, rows: int) -> str:
    """A formula as it reads so many columns and rows away; a reference that leaves the sheet is #REF!."""

    def column(fixed: str, letters: str) -> str | None:
        n = column_number(letters.upper()) + (0 if fixed else cols)
        return fixed + column_letters(n) if 0 < n <= 16384 else None

    def line(fixed: str, digits: str) -> str | None:
        n = int(digits) + (0 if fixed else rows)
        return f"{fixed}{n}" if 0 < n <= 1048576 else None

    def one(m: re.Match) -> str:
        if m[1]:
            return m[0]
        if m[3]:
            both, between = (column(m[2], m[3]), line(m[4], m[5])), ""
        elif m[7]:
            both, between = (column(m[6], m[7]), column(m[8], m[9])), ":"
        else:
            both, between = (line(m[10], m[11]), line(m[12], m[13])), ":"
        return "#REF!" if None in both else between.join(both)

    return SHIFTED.sub(one, formula)


#: What a file that is no workbook, or a damaged one, raises while it is read.
DAMAGED = (zipfile.BadZipFile, KeyError, AttributeError, ValueError, IndexError, ET.ParseError)
NAMES = "workbook_id string, name string, target string"
REJECTED = "workbook_id string, reason string"


def each_file(spark: SparkSession, path: str, rows_of: Callable[[str, bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """rows_of(name, content) of all .xlsx files at path: one task takes a file, the result is one long table. Files that
    can't be read give no rows; read_rejected says which and why."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).filter(f"length <= {MOST_BYTES} AND substring(content, 1, 2) = X'504B'")
    columns = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in zip(f["path"], f["content"], strict=True):
                try:
                    rows = list(rows_of(name, content))
                except DAMAGED:
                    continue
                yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(run, schema)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all .xlsx files at path."""
    return each_file(spark, path, cells_of, SCHEMA)


def read_hidden(spark: SparkSession, path: str) -> DataFrame:
    """Hidden rows and columns of all .xlsx files at path, as audit() takes them."""
    return each_file(spark, path, hidden_of, HIDDEN)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """Defined names, and columns of tables as Table[Column], with the references they stand for; as parsed() takes them."""
    return each_file(spark, path, names_of, NAMES)


def read_rejected(spark: SparkSession, path: str) -> DataFrame:
    """Files at path that read_files leaves out, with the reason: too large, no zip file, or what is damaged."""
    files = spark.read.format("binaryFile").load(path)
    large, kind = F.col("length") > MOST_BYTES, ~F.lower("path").endswith(".xlsx")
    early = F.when(kind, "not named .xlsx").when(large, f"larger than {MOST_BYTES} bytes").when(F.expr("substring(content, 1, 2) <> X'504B'"), "no zip file")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for name, content, reason in zip(f["path"], f["content"], f["reason"], strict=True):
                if reason is None:
                    try:
                        for rows in (cells_of, hidden_of, names_of):
                            list(rows(name, content))
                    except DAMAGED as error:
                        reason = f"{type(error).__name__}: {error}"[:200]
                if reason is not None:
                    out.append((name, reason))
            yield pd.DataFrame(out, columns=["workbook_id", "reason"])

    return files.select("path", F.when(early.isNull(), F.col("content")).alias("content"), early.alias("reason")).mapInPandas(run, REJECTED)


def names_of(name: str, content: bytes) -> Iterator[tuple]:
    """Defined names and table columns of a file. Only the data rows of a table count, without its header and totals."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        tree = lambda p: ET.fromstring(z.read(p))
        book = tree("xl/workbook.xml")
        for x in book.iter(MAIN + "definedName"):
            if x.text and not x.get("name", "").startswith("_xlnm."):
                yield name, x.get("name"), x.text.lstrip("=")
        targets = {r.get("Id"): r.get("Target") for r in tree("xl/_rels/workbook.xml.rels")}
        for sheet in book.iter(MAIN + "sheet"):
            part = targets[sheet.get(LINK)].lstrip("/")
            part = part if part.startswith("xl/") else f"xl/{part}"
            folder, _, file = part.rpartition("/")
            links = f"{folder}/_rels/{file}.rels"
            for r in tree(links) if links in z.namelist() else ():
                if not r.get("Type", "").endswith("/table"):
                    continue
                t = tree(posixpath.normpath(posixpath.join(folder, r.get("Target"))).lstrip("/") if not r.get("Target").startswith("/") else r.get("Target").lstrip("/"))
                first, _, last = t.get("ref").partition(":")
                (c1, r1, _, _), (c2, r2, _, _) = reference(first), reference(last or first)
                r1, r2 = r1 + int(t.get("headerRowCount", 1)), r2 - int(t.get("totalsRowCount", 0))
                owner = "'" + sheet.get("name").replace("'", "''") + "'!"
                spans = [(c.get("name"), c1 + i, c1 + i) for i, c in enumerate(t.iter(MAIN + "tableColumn"))] + [("", c1, c2)]
                if r1 <= r2:
                    yield from ((name, f"{t.get('displayName')}[{column}]", f"{owner}{column_letters(a)}{r1}:{column_letters(b)}{r2}") for column, a, b in spans)


def hidden_of(name: str, content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        tree = lambda p: ET.fromstring(z.read(p))
        targets = {r.get("Id"): r.get("Target") for r in tree("xl/_rels/workbook.xml.rels")}
        for sheet in tree("xl/workbook.xml").iter(MAIN + "sheet"):
            part = targets[sheet.get(LINK)].lstrip("/")
            own, last = tree(part if part.startswith("xl/") else f"xl/{part}"), 0
            for row in own.iter(MAIN + "row"):
                last = int(row.get("r", last + 1))
                if row.get("hidden") in ("1", "true"):
                    yield name, sheet.get("name"), "row", last
            for c in own.iter(MAIN + "col"):
                if c.get("hidden") in ("1", "true"):
                    yield from ((name, sheet.get("name"), "col", n) for n in range(int(c.get("min")), int(c.get("max")) + 1))


def formats_of(z: zipfile.ZipFile) -> list[str]:
    """The number format of each cell style."""
    if "xl/styles.xml" not in z.namelist():
        return []
    styles = ET.fromstring(z.read("xl/styles.xml"))
    named = FORMATS | {int(x.get("numFmtId")): x.get("formatCode") for x in styles.iter(MAIN + "numFmt")}
    kinds = styles.find(MAIN + "cellXfs")
    return [named.get(int(x.get("numFmtId", 0)), "General") for x in (kinds if kinds is not None else [])]


def lanes(kind: str, text: str | None, shared: list[str]) -> tuple:
    """number, text, flag and error of a stored value."""
    if text is None:
        return None, None, None, None
    if kind == "s":
        return None, shared[int(text)], None, None
    if kind in ("str", "inlineStr"):
        return None, text, None, None
    if kind == "b":
        return None, None, text == "1", None
    if kind == "e":
        return None, None, None, text
    return float(text), None, None, None


def cells_of(name: str, content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        tree = lambda p: ET.fromstring(z.read(p))
        shared = ["".join(t.text or "" for t in si.iter(MAIN + "t")) for si in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
        targets = {r.get("Id"): r.get("Target") for r in tree("xl/_rels/workbook.xml.rels")}
        formats = formats_of(z)
        for sheet in tree("xl/workbook.xml").iter(MAIN + "sheet"):
            part = targets[sheet.get(LINK)].lstrip("/")
            own = tree(part if part.startswith("xl/") else f"xl/{part}")
            masters: dict[str, tuple[int, int, str]] = {}  # of formulas filled down or across
            for c in own.iter(MAIN + "c"):
                f = c.find(MAIN + "f")
                if f is not None and f.get("t") == "shared" and f.text:
                    letters, row = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
                    masters.setdefault(f.get("si"), (column_number(letters), int(row), f.text))
            for c in own.iter(MAIN + "c"):
                letters, row = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
                f, v = c.find(MAIN + "f"), c.find(MAIN + "v")
                text = "".join(t.text or "" for t in c.iter(MAIN + "t")) if c.get("t") == "inlineStr" else v.text if v is not None else None
                value = lanes(c.get("t", "n"), text, shared)
                formula = "=" + f.text if f is not None and f.text else None
                if formula is None and f is not None and f.get("t") == "shared" and f.get("si") in masters:
                    col, line, shared_text = masters[f.get("si")]
                    formula = "=" + shifted(shared_text, column_number(letters) - col, int(row) - line)
                style = int(c.get("s", 0))
                if formula or any(x is not None for x in value):
                    none = (None,) * 4
                    yield (name, sheet.get("name"), column_number(letters), int(row), formula, *(none if formula else value), *(value if formula else none), formats[style] if style < len(formats) else "General")


def file_of(sheets: dict[str, dict[str, object]]) -> bytes:
    """A workbook file of {sheet: {"A1": value or "=formula"}}."""
    escape = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")

    def cell(place: str, v: object) -> str:
        if isinstance(v, str) and v.startswith("="):
            return f'<c r="{place}"><f>{escape(v[1:])}</f></c>'
        if isinstance(v, bool):
            return f'<c r="{place}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, str):
            return f'<c r="{place}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'
        return f'<c r="{place}"><v>{v!r}</v></c>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1)) + "</Types>")
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, cells in enumerate(sheets.values(), 1):
            place = lambda p: (int(re.sub(r"\D", "", p)), column_number(re.sub(r"\d", "", p)))
            rows: dict[int, list[str]] = {}
            for p in sorted(cells, key=place):
                rows.setdefault(place(p)[0], []).append(cell(p, cells[p]))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {ns}><sheetData>" + "".join(f'<row r="{r}">{"".join(cs)}</row>' for r, cs in rows.items()) + "</sheetData></worksheet>")
    return out.getvalue()


def corrected(content: bytes, edits: dict[tuple[str, int, int], str]) -> bytes:
    """A copy of a file with other formulas at (sheet, col, row); their saved values go, and the source stays as it is."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as to:
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        parts = {}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(MAIN + "sheet"):
            part = targets[sheet.get(LINK)].lstrip("/")
            parts[part if part.startswith("xl/") else f"xl/{part}"] = sheet.get("name")
        for item in z.infolist():
            raw = z.read(item)
            mine = {f"{column_letters(c)}{r}": f for (s, c, r), f in edits.items() if s == parts.get(item.filename)}
            if mine:
                ET.register_namespace("", MAIN[1:-1])
                tree = ET.fromstring(raw)
                # Formulas filled from another cell get a text of their own, so that they outlive an edit of that cell.
                masters: dict[str, tuple[int, int, str]] = {}
                filled = [(c.get("r"), f) for c in tree.iter(MAIN + "c") if (f := c.find(MAIN + "f")) is not None and f.get("t") == "shared"]
                place = lambda r: (column_number(re.sub(r"\d", "", r)), int(re.sub(r"\D", "", r)))
                for r, f in filled:
                    if f.text:
                        masters.setdefault(f.get("si"), (*place(r), f.text))
                for r, f in filled:
                    if f.get("si") in masters:
                        col, row, text = masters[f.get("si")]
                        f.text = f.text or shifted(text, place(r)[0] - col, place(r)[1] - row)
                        f.attrib.clear()
                for c in tree.iter(MAIN + "c"):
                    if c.get("r") in mine:
                        for child in list(c):
                            c.remove(child)
                        c.attrib.pop("t", None)
                        ET.SubElement(c, MAIN + "f").text = mine[c.get("r")].lstrip("=")
                raw = ET.tostring(tree)
            to.writestr(item, raw)
    return out.getvalue()
