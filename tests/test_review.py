"""Grouping, pricing, headlines, traces and repairs on grids, against values derived by hand and a plain walk."""

import json

from collections import deque

import pytest

from pyspark.sql import functions as F

from sheafcalc.operators.cells import make_cells
from sheafcalc.operators.repairs import verified_repairs
from sheafcalc.operators.rules import Audit, audit, grouped, stats
from sheafcalc.operators.trials import price, traced
from sheafcalc.sources.history import append_run, latest_runs, recent_runs, report
from sheafcalc.storage import stored

BOOK = {
    "A1": "Hay", "B1": 10, "C1": 3, "D1": 7, "A2": "Oats", "B2": 20, "C2": 4, "D2": 8, "A3": "Straw", "B3": 5, "C3": 6, "D3": 9,
    "B4": "=SUM(B1:B2)", "C4": "=SUM(C1:C2)", "D4": "=SUM(D1:D2)", "A6": "Margin", "B6": "=B4*2+C4", "B7": "=B4+1", "A8": "Ratio", "B8": "=D4/2",
    "A9": "Fixed", "B9": "=5*2", "A10": "Share", "B10": "=100/(D4-15)+100", "C10": "=B10",
}


@pytest.fixture(scope="module")
def book(spark):
    return make_cells(spark, BOOK).withColumn("number_format", F.when((F.col("row") == 6) & (F.col("col") == 2), "$0.00").otherwise("General"))


@pytest.fixture(scope="module")
def audited(book):
    return stored(audit(book, only=["R001"]))


@pytest.fixture(scope="module")
def top(audited):
    return audited.collect()


def test_neighbours_are_one_finding(top):
    (f,) = top
    assert (f.cell, f.group_cells, f.rank) == ("Sheet!2!4", ["Sheet!2!4", "Sheet!3!4", "Sheet!4!4"], 1)
    assert [(e.col, e.formula) for e in f.edits] == [(2, "=SUM(B1:B3)"), (3, "=SUM(C1:C3)"), (4, "=SUM(D1:D3)")]
    assert f.confidence == pytest.approx(0.97)


def test_edits_of_a_group_are_priced_together(top):
    (f,) = top
    # B10 was an error (100/0) and is a number then; B6 counts threefold as money.
    assert {c.cell: (c.before, c.after) for c in f.changes} == {
        "Sheet!2!4": (30, 35), "Sheet!3!4": (7, 13), "Sheet!4!4": (15, 24), "Sheet!2!6": (67, 83), "Sheet!2!7": (31, 36), "Sheet!2!8": (7.5, 12), "Sheet!2!10": (None, pytest.approx(100 / 9 + 100)), "Sheet!3!10": (None, pytest.approx(100 / 9 + 100)),
    }
    assert (f.impact, f.impact_cell, f.impact_before, f.impact_after, f.cells) == (16, "Sheet!2!6", 67, 83, 8)
    assert f.verified


def test_headlines_and_their_trace(top):
    (f,) = top
    # B7 has no label, B9 does not move, B10 feeds C10.
    assert [(h.cell, h.label, h.currency) for h in f.headlines] == [("Sheet!3!10", "Share", False), ("Sheet!2!6", "Margin", True), ("Sheet!2!8", "Ratio", False)]
    steps = [(t.cell, t.depth, t.is_input, t.changed) for t in f.trace]
    assert steps[:3] == [("Sheet!3!10", 0, False, True), ("Sheet!2!10", 1, False, True), ("Sheet!4!4", 2, False, True)]
    assert steps[3:] == [("Sheet!4!1", 3, True, False), ("Sheet!4!2", 3, True, False)]
    assert (f.trace[2].formula, f.trace[2].value.n, f.trace[0].label) == ("=SUM(D1:D2)", 15, "Share")


def test_only_like_neighbours_are_grouped(spark):
    kind = "workbook_id string, rule string, cell string, sheet string, col int, row int, title string, evidence map<string,string>, confidence double, fix string"
    row = lambda rule, col, row, label, fix="=1": ("w", rule, f"S!{col}!{row}", "S", col, row, "t", {"missing_label": label}, 0.6, fix)
    rows = [row("R001", 2, 1, "x"), row("R001", 3, 1, "x"), row("R001", 5, 1, "x"), row("R001", 6, 1, "y"), row("R001", 2, 2, "x"), row("R003", 2, 3, "x"), row("R003", 3, 3, "x"), row("R004", 2, 4, None, None), row("R004", 3, 4, None, None), row("R008", 2, 5, None), row("R008", 3, 5, None)]
    got = sorted((r.rule, r.cell, len(r.group_cells), r.edits and len(r.edits)) for r in grouped(spark.createDataFrame(rows, kind)).collect())
    assert got == [("R001", "S!2!1", 2, 2), ("R001", "S!2!2", 1, 1), ("R001", "S!5!1", 1, 1), ("R001", "S!6!1", 1, 1), ("R003", "S!2!3", 1, 1), ("R003", "S!3!3", 1, 1), ("R004", "S!2!4", 1, None), ("R004", "S!3!4", 1, None), ("R008", "S!2!5", 2, 2)]


def test_a_fix_that_makes_an_error_is_not_verified(spark, book):
    kind = "workbook_id string, rule string, cell string, sheet string, col int, row int, fix string, severity string, confidence double"
    fixes = [("w", "X1", "Sheet!4!4", "Sheet", 4, 4, "=D1/0", "critical", 0.9), ("w", "X2", "Sheet!2!4", "Sheet", 2, 4, "=B1", "critical", 0.9), ("w", "X3", "Sheet!2!4", "Sheet", 2, 4, "=NOSUCH(1)", "info", 0.1)]
    got = {r.rule: r for r in price(Audit(book), spark.createDataFrame(fixes, kind)).collect()}
    assert {k: r.verified for k, r in got.items()} == {"X1": False, "X2": True, "X3": False}
    assert (got["X2"].impact, got["X2"].cells) == (40, 3)


def walked(grid, feeds, start, changed, depth=6, steps=60, children=8, still=4):
    """The same walk with a queue."""
    out, seen, left = [], set(), deque([(start, 0)])
    while left and len(out) < steps:
        x, d = left.popleft()
        if x in seen or d > depth:
            continue
        seen.add(x)
        out.append((x, d))
        before = sorted(feeds.get(x, ()))
        if changed is not None:
            before = [c for c in before if c in changed] or before[:still]
        left.extend((c, d + 1) for c in before[:children] if c not in seen)
    return out


@pytest.mark.parametrize("mark", [True, False])
def test_traces_equal_a_queue(spark, mark):
    rows, feeds = {}, {}
    for c in range(1, 10):
        for r in range(1, 13):
            name, here = f"{'ABCDEFGHI'[c - 1]}{r}", ("Sheet", c, r)
            if c == 1:
                rows[name] = r
                continue
            low, high = max(1, r - 1 - c % 3), min(12, r + 1 + r % 4)
            other = 1 + (r * 5 + c) % 12
            rows[name] = f"=SUM({'ABCDEFGHI'[c - 2]}{low}:{'ABCDEFGHI'[c - 2]}{high})+A{other}"
            feeds[here] = {("Sheet", c - 1, k) for k in range(low, high + 1)} | {("Sheet", 1, other)}
    a = Audit(make_cells(spark, rows))
    moves = {("Sheet", c, r) for c in range(1, 10) for r in range(1, 13) if (c * 7 + r * 3) % 5 < 2}
    starts = [("k1", "Sheet", 9, 6), ("k2", "Sheet", 9, 12), ("k3", "Sheet", 4, 1), ("k4", "Sheet", 1, 2)]
    kind = "copy string, workbook_id string, sheet string, col int, row int"
    at = spark.createDataFrame([(k, "w", *x) for k, *x in starts], kind)
    changed = spark.createDataFrame([(k, "w", *x) for k, *_ in starts for x in sorted(moves)], kind) if mark else None
    got = {}
    for r in traced(a, at, changed).orderBy("step").collect():
        got.setdefault(r.copy, []).append(((r.sheet, r.col, r.row), r.depth))
    for k, *x in starts:
        assert got[k] == walked(rows, feeds, tuple(x), moves if mark else None)


def test_repairs_are_proved(spark, book):
    place = lambda col, row, formula, sheet="Sheet": (sheet, col, row, formula)
    right = [place(2, 4, "=SUM(B1:B3)"), place(3, 4, "=SUM(C1:C3)"), place(4, 4, "=SUM(D1:D3)")]
    asked = {
        "right": right, "one of three": right[:1], "stays": [place(2, 4, "=SUM(B1:B2)+0")], "errs": [place(2, 4, "=B1/0")],
        "errs by another": [place(2, 4, "=IF(1,-C4/2)"), place(2, 7, "=1/(B4+3.5)")], "breaks another": [place(2, 4, '="x"')], "unread": [place(2, 4, "=SUM(B1")], "no formula": [place(2, 4, "35")], "elsewhere": [place(1, 1, "=1", "Gone")],
        "none": [], "twice": [place(2, 4, "=1"), place(2, 4, "=2")], "many": [place(9, r, "=1") for r in range(1, 10)], "into a blank": [place(6, 1, "=B1+B2+B3"), place(2, 4, "=F1")],
        "new one": [place(2, 4, "=SUM(B1:B3)"), place(6, 4, "=SUM(B1:B2)")],
    }
    kind = "workbook_id string, proposal string, rule string, sheet string, col int, row int, edits array<struct<sheet:string,col:int,row:int,formula:string>>"
    rows = [("w", k, "R001", "Sheet", 2, 4, v) for k, v in asked.items()]
    got = {r.proposal: r for r in verified_repairs(Audit(book), spark.createDataFrame(rows, kind), only=["R001", "R013"]).collect()}
    assert {k for k, r in got.items() if r.accepted} == {"right", "one of three", "into a blank"}
    assert {k: r.reason for k, r in got.items() if not r.accepted} == {
        "stays": "the finding stays", "errs": "an edit gives an error", "errs by another": "an edit gives an error", "breaks another": "another cell errs", "unread": "an edit does not parse", "no formula": "an edit is not a formula", "elsewhere": "an edit is not in the workbook",
        "none": "no edit", "twice": "two edits of one cell", "many": "more than 8 edits", "new one": "a new finding comes",
    }
    assert (got["right"].changed, got["into a blank"].changed) == (8, 4)


def test_reports_and_runs(spark, audited, book, tmp_path):
    df = audited
    text = json.loads(report(df, stats(Audit(book))).first().report)
    one = text["findings"][0]
    assert text["stats"]["formulas"] == sum(str(v).startswith("=") for v in BOOK.values())
    assert (text["at_risk"], len(one["edits"]), one["headlines"][1]["label"], one["trace"][0]["cell"], one["verified"]) == (16, 3, "Margin", "Sheet!3!10", True)
    for k in range(3):
        append_run(df, str(tmp_path / "runs"), f"r{k}")
    runs = spark.read.parquet(str(tmp_path / "runs"))
    assert latest_runs(runs).first().run_id == "r2"
    assert [r.run_id for r in recent_runs(runs, 2).collect()] == ["r2", "r1"]
