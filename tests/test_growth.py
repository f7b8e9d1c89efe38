"""What must not grow with the number of workbooks: rows through the driver, calls of grouped functions, formulas read."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sheafcalc import tables
from sheafcalc.functions import scalar as S
from sheafcalc.operators import cells as K
from sheafcalc.operators import graph
from sheafcalc.operators.recalc import recalculated
from sheafcalc.storage import MEASURED, STATIC, sizes_measured, stored


def test_small_files_of_many_rows_are_no_broadcast(spark):
    many = stored(spark.range(200_000).select((F.col("id") % 3).alias("k"), F.lit("the same text in every row").alias("s")))
    few = spark.range(200_000).select((F.col("id") % 3).alias("k"), "id")
    plan = lambda: few.join(many.limit(100_000), "k", "left")._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get(STATIC)
    with sizes_measured(spark):
        assert "BroadcastHashJoin" not in plan()
        assert spark.conf.get(MEASURED) == before
    assert "BroadcastHashJoin" in plan()
    assert spark.conf.get(STATIC) == before and spark.conf.get(MEASURED, None) is None


def test_small_workbooks_share_a_call(spark):
    books = spark.range(3000).select(F.col("id").cast("string").alias("workbook_id"))
    assert books.select(graph.batch(2 * graph.BATCH)).distinct().count() <= 3
    # Chains are contracted in deep workbooks alone, also where a flat one and a cycle come in the same call.
    e = [("deep", f"deep!{i}", f"deep!{i + 1}", True, 0) for i in range(20)] + [("flat", f"flat!{i}", f"flat!{i + 1}", True, 0) for i in range(3)] + [("loop", "loop!0", "loop!1", True, 0), ("loop", "loop!1", "loop!0", True, 0)]
    edges = spark.createDataFrame(e, "workbook_id string, src string, dst string, linear boolean, pos int")
    nodes = edges.select("workbook_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    found, held = graph.workbook_levels(edges, nodes)
    got = {r.node: (r.level, r.depth, r.up) for r in found.collect()}
    assert {k: v for k, v in got.items() if k.startswith("flat")} == {f"flat!{i}": (i, 0, None) for i in range(4)}
    assert got["deep!20"] == (0, 20, "deep!19") and got["deep!0"] == (0, 0, None)
    assert {r.node for r in held.collect()} == {"loop!0", "loop!1"}
    starts = spark.createDataFrame([("deep", "deep!18"), ("flat", "flat!2"), ("loop", "loop!1")], "workbook_id string, node string")
    pairs = {(r.workbook_id, r.start, r.node) for r in graph.reached(edges, starts).collect()}
    assert pairs == {("deep", "deep!18", f"deep!{i}") for i in (18, 19, 20)} | {("flat", "flat!2", f"flat!{i}") for i in (2, 3)} | {("loop", "loop!1", f"loop!{i}") for i in (0, 1)}


def test_equal_formulas_are_read_once_each_place_its_own(spark, monkeypatch):
    rows = [(str(w), "S", 1, 1, None, float(w)) for w in range(40)] + [(str(w), "S", 2, r, "=A1*2" if r < 3 else "=SUM(", None) for w in range(40) for r in (1, 2, 3)]
    cells = spark.createDataFrame([(*r, None, None, None, None, None, None, None, "General") for r in rows], K.SCHEMA)
    got = {(r.workbook_id, r.row): r.value for r in recalculated(cells).filter("col = 2").collect()}
    assert all(got[str(w), r].n == 2 * w for w in range(40) for r in (1, 2)) and all(got[str(w), 3].e == "#N/A" or got[str(w), 3].e for w in range(40))
    p = K.parsed(cells).collect()
    assert len(p) == 120 and {(r.row, r.sig) for r in p if r.parse_error is None} == {(1, p_.sig) for p_ in p if p_.row == 1} | {(2, p_.sig) for p_ in p if p_.row == 2}
    names = spark.createDataFrame([("0", "X", "A1"), ("1", "X", "A2")], "workbook_id string, name string, target string")
    two = spark.createDataFrame([(w, "S", 2, 1, "=X+1", None, None, None, None, None, None, None, None, "General") for w in ("0", "1")], K.SCHEMA)
    assert {r.workbook_id: r.refs[0].r1 for r in K.parsed(two.coalesce(1), names).collect()} == {"0": 1, "1": 2}
    calls = []
    monkeypatch.setattr(K, "parts", lambda *x: calls.append(x) or (None, None, None, [], [], [], [], [], [], [], 0, "no"))
    frame = type("Frame", (), {"filter": lambda s, *_: s, "select": lambda s, *_: s, "withColumn": lambda s, *_: s, "mapInArrow": lambda s, f, _: f})()
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"workbook_id": [str(w) for w in range(40)], "sheet": ["S"] * 40, "col": pa.array([2] * 40, pa.int32()), "row": pa.array([1] * 40, pa.int32()), "formula": ["=A1*2"] * 40, "names": pa.array([None] * 40, pa.map_(pa.string(), pa.string()))})
    assert next(K.parsed(frame)(iter([batch]))).num_rows == 40 and len(calls) == 1


def test_rate_of_many_flows(spark):
    many = [-100.0] + [2.0] * 400
    rows = [(0, many), (1, [-100.0, 60.0, 60.0]), (2, [1.0, 2.0]), (3, []), (4, [-1.0, 1.0])]
    r = S.irr(F.col("x"))
    got = {x.k: (x.rate, x.error) for x in spark.createDataFrame(rows, "k int, x array<double>").select("k", r.value.alias("rate"), r.error.alias("error")).collect()}
    worth = lambda x, rate: sum(v / (1 + rate) ** i for i, v in enumerate(x))
    assert abs(worth(many, got[0][0])) < 1e-9 and abs(worth(rows[1][1], got[1][0])) < 1e-9 and abs(got[4][0]) < 1e-15
    assert [got[k][1] for k in range(5)] == [None, None, "#NUM!", "#NUM!", None]


def test_flows_are_computed_once(spark):
    plan = spark.range(1).select(S.irr(F.array(F.col("id").cast("double"), F.lit(7.25))).value)._jdf.queryExecution().analyzed().toString()
    assert plan.count("7.25") <= 4  # value and error, none in a step


def test_tasks_follow_rows(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_EACH", 1000)
    x = tables.dealt(spark.range(20_000), "id")
    assert x.rdd.getNumPartitions() == 21
    y = x.groupBy("id", (F.col("id") % 7).alias("m")).agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("m")))
    assert y._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
