"""Audit rules and audit operators over the tables: an order is a total, its lines are the cells below it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheafcalc.functions.scalar import divide
from sheafcalc.functions.values import values_equal
from sheafcalc.operators import findings as FD
from sheafcalc.operators import guard
from sheafcalc.plans.registry import query
from sheafcalc.tables import dealt, read

C = F.col
LINES_SQL = "PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice"
NET = "CAST(l_extendedprice * (1 - l_discount) * (1 + l_tax) AS DECIMAL(28,6))"


def lines():
    """Lines of an order in a fixed order."""
    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def recomputed(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum((C("l_extendedprice") * (1 - C("l_discount")) * (1 + C("l_tax"))).cast("decimal(28,6)")).cast("double").alias("recomputed"))


@query("audit_selfcheck", f"""
WITH r AS (SELECT l_orderkey, CAST(sum({NET}) AS DOUBLE) AS recomputed FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_totalprice AS saved, coalesce(recomputed, 0) AS recomputed, abs(o_totalprice - coalesce(recomputed, 0)) <= 1e-9 * greatest(1, abs(o_totalprice), abs(coalesce(recomputed, 0))) AS matched FROM orders LEFT JOIN r ON o_orderkey = l_orderkey""")
def audit_selfcheck(spark: SparkSession, d: str) -> DataFrame:
    """Saved totals against totals recalculated from the lines, within a relative 1e-9."""
    x = read(spark, d, "orders").join(recomputed(spark, d), C("o_orderkey") == C("l_orderkey"), "left")
    now = F.coalesce("recomputed", F.lit(0.0))
    return x.select("o_orderkey", C("o_totalprice").alias("saved"), now.alias("recomputed"), values_equal(C("o_totalprice"), now).alias("matched"))


@query("audit_selfcheck_totals", f"""
WITH r AS (SELECT l_orderkey, CAST(sum({NET}) AS DOUBLE) AS v FROM lineitem GROUP BY 1), m AS (SELECT v IS NULL AS blank, abs(o_totalprice - coalesce(v, 0)) <= 1e-9 * greatest(1, abs(o_totalprice), abs(coalesce(v, 0))) AS ok FROM orders LEFT JOIN r ON o_orderkey = l_orderkey)
SELECT count(*) AS checked, count(*) FILTER (WHERE ok) AS matched, count(*) FILTER (WHERE NOT ok) AS mismatched, count(*) FILTER (WHERE blank) AS unsupported, count(*) FILTER (WHERE ok) >= 0.995 * count(*) AS trusted FROM m""")
def audit_selfcheck_totals(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "orders").join(recomputed(spark, d), C("o_orderkey") == C("l_orderkey"), "left")
    ok = values_equal(C("o_totalprice"), F.coalesce("recomputed", F.lit(0.0)))
    return x.agg(F.count("*").alias("checked"), F.count_if(ok).alias("matched"), F.count_if(~ok).alias("mismatched"), F.count_if(C("recomputed").isNull()).alias("unsupported"), (F.count_if(ok) >= 0.995 * F.count("*")).alias("trusted"))


@query("rule_r001_range_omission", f"""
WITH r AS (SELECT l_orderkey, l_extendedprice, row_number() OVER ({LINES_SQL}) AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT l_orderkey, max(n) AS lines, CAST(sum(CASE WHEN pos < n THEN CAST(l_extendedprice AS DECIMAL(28,6)) ELSE 0 END) AS DOUBLE) AS total_short, max(CASE WHEN pos = n THEN l_extendedprice END) AS missing FROM r WHERE n > 2 GROUP BY 1""")
def rule_r001(spark: SparkSession, d: str) -> DataFrame:
    """A total that stops one line early: the short total and the missing value, for orders of three lines or more."""
    x = read(spark, d, "lineitem").withColumn("pos", F.row_number().over(lines())).withColumn("n", F.count("*").over(Window.partitionBy("l_orderkey"))).filter("n > 2")
    return x.groupBy("l_orderkey").agg(F.max("n").alias("lines"), F.sum(F.when(C("pos") < C("n"), C("l_extendedprice")).otherwise(0).cast("decimal(28,6)")).cast("double").alias("total_short"), F.max(F.when(C("pos") == C("n"), C("l_extendedprice"))).alias("missing"))


@query("rule_r002_pattern_break", f"""
WITH r AS (SELECT l_orderkey, l_returnflag AS sig, row_number() OVER ({LINES_SQL}) AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
m AS (SELECT l_orderkey, sig, count(*) AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY count(*) DESC, sig) AS best FROM r GROUP BY 1, 2)
SELECT r.l_orderkey, pos, r.sig, m.sig AS majority, k AS agreeing, n AS run, round(least(0.95, 0.55 + 0.4 * k / n), 6) AS confidence FROM r JOIN m ON r.l_orderkey = m.l_orderkey AND best = 1 WHERE n >= 4 AND k >= n - 2 AND k >= 0.7 * n AND r.sig <> m.sig""")
def rule_r002(spark: SparkSession, d: str) -> DataFrame:
    """In runs of four or more, the few members that break the majority pattern."""
    x = read(spark, d, "lineitem").withColumn("pos", F.row_number().over(lines()).cast("long")).select(C("l_orderkey").alias("run_id"), "pos", C("l_returnflag").alias("sig"))
    return FD.pattern_breaks(x, ["run_id"], "sig").select(C("run_id").alias("l_orderkey"), "pos", "sig", "majority", "agreeing", "run", F.round("confidence", 6).alias("confidence"))


@query("rule_r003_hidden_constant", r"""
SELECT doc_id, CAST(len([x FOR x IN regexp_extract_all(coalesce(text, ''), '[0-9]+(?:\.[0-9]+)?') IF CAST(x AS DOUBLE) NOT IN (-1, 0, 1, 2, 4, 7, 12, 24, 60, 100, 365, 1000)]) AS BIGINT) AS n_constants FROM documents""")
def rule_r003(spark: SparkSession, d: str) -> DataFrame:
    """Number literals that are not benign ones, counted for each text."""
    found = F.expr(r"regexp_extract_all(coalesce(text, ''), '[0-9]+(?:\\.[0-9]+)?', 0)")
    return read(spark, d, "documents").select("doc_id", F.size(F.filter(found, lambda x: ~x.cast("double").isin(*FD.BENIGN))).cast("long").alias("n_constants"))


@query("rule_r004_blank_reference", "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def rule_r004(spark: SparkSession, d: str) -> DataFrame:
    """Orders that refer to lines that are not there."""
    return read(spark, d, "orders").join(read(spark, d, "lineitem"), C("o_orderkey") == C("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


@query("rule_r005_error_roots", """
SELECT o_orderkey, count(*) FILTER (WHERE l_discount = 0) AS roots, count(*) FILTER (WHERE l_discount = 0) > 0 AS inherited FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(*) FILTER (WHERE l_discount = 0) > 0""")
def rule_r005(spark: SparkSession, d: str) -> DataFrame:
    """Lines whose ratio is an error are roots; their order inherits it."""
    q = divide(C("l_tax"), C("l_discount"))
    x = read(spark, d, "lineitem").filter(q.error.isNotNull()).groupBy("l_orderkey").agg(F.count("*").alias("roots"))
    return read(spark, d, "orders").join(x, C("o_orderkey") == C("l_orderkey")).select("o_orderkey", "roots", F.lit(True).alias("inherited"))


@query("rule_r007_broken_reference", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)")
def rule_r007(spark: SparkSession, d: str) -> DataFrame:
    """Lines that refer to a supplier that is not among those in credit."""
    have = read(spark, d, "supplier").filter("s_acctbal >= 0").select("s_suppkey")
    return read(spark, d, "lineitem").join(have, C("l_suppkey") == C("s_suppkey"), "left_anti").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")


@query("rule_r008_number_as_text", """
SELECT event_id, regexp_extract(props, '[0-9]+') AS cell, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS missing FROM events WHERE regexp_matches(props, '[0-9]+')""")
def rule_r008(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that stand as text inside props and so miss every total."""
    x = read(spark, d, "events").withColumn("cell", F.regexp_extract("props", "[0-9]+", 0))
    return x.filter(FD.looks_numeric(C("cell"))).select("event_id", "cell", FD.numeric_text(C("cell")).alias("missing"))


@query("rule_r009_double_count", """
SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(28,6))) AS DOUBLE) AS qty, CAST(grouping(l_returnflag) + grouping(l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rule_r009(spark: SparkSession, d: str) -> DataFrame:
    """Subtotals and the grand total side by side: level says which rows a total must not add again."""
    x = read(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus")
    return x.agg(F.count("*").alias("n"), F.sum(C("l_quantity").cast("decimal(28,6)")).cast("double").alias("qty"), (F.grouping("l_returnflag") + F.grouping("l_linestatus")).cast("long").alias("level"))


@query("rule_r010_duplicate_formula", """
SELECT count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE length(text) >= 18 GROUP BY upper(text) HAVING count(*) >= 2""")
def rule_r010(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "documents").filter(F.length("text") >= 18)
    return x.groupBy(F.upper("text").alias("formula")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies >= 2").drop("formula")


@query("rule_r011_volatile", r"""
SELECT doc_id, CAST(len(regexp_extract_all(upper(coalesce(text, '')), '\b(?:NOW|TODAY|RAND|RANDBETWEEN|OFFSET|INDIRECT|CELL|INFO)\b')) AS BIGINT) AS n FROM documents""")
def rule_r011(spark: SparkSession, d: str) -> DataFrame:
    """Names of volatile functions in texts."""
    return read(spark, d, "documents").select("doc_id", F.expr(r"cast(regexp_count(upper(coalesce(text, '')), '\\b(?:" + "|".join(FD.VOLATILE) + r")\\b') as bigint)").alias("n"))


@query("rule_r012_masked_error", "SELECT l_returnflag, count(*) FILTER (WHERE l_discount = 0) AS masked, count(*) AS n FROM lineitem GROUP BY 1")
def rule_r012(spark: SparkSession, d: str) -> DataFrame:
    """Divisions whose error an IFERROR would hide."""
    q = divide(C("l_tax"), C("l_discount"))
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(q.error.isNotNull()).alias("masked"), F.count("*").alias("n"))


@query("rule_r013_stale_value", f"""
WITH r AS (SELECT l_orderkey, CAST(sum({NET}) AS DOUBLE) AS v FROM lineitem GROUP BY 1), m AS (SELECT o_orderkey, o_totalprice AS saved, v AS now, abs(o_totalprice - v) > 1e-9 * greatest(1, abs(o_totalprice), abs(v)) AS stale FROM orders JOIN r ON o_orderkey = l_orderkey),
g AS (SELECT count(*) FILTER (WHERE stale) > greatest(20, 0.25 * count(*)) AS silent FROM m)
SELECT o_orderkey, saved, now, silent FROM m, g WHERE stale""")
def rule_r013(spark: SparkSession, d: str) -> DataFrame:
    """Saved values that differ from recalculated ones; silent says that so many differ that the rule holds its tongue."""
    x = read(spark, d, "orders").join(recomputed(spark, d), C("o_orderkey") == C("l_orderkey"))
    x = x.withColumn("stale", ~values_equal(C("o_totalprice"), C("recomputed")))
    gate = x.agg((F.count_if("stale") > F.greatest(F.lit(20.0), 0.25 * F.count("*"))).alias("silent"))
    return x.filter("stale").join(F.broadcast(gate)).select("o_orderkey", C("o_totalprice").alias("saved"), C("recomputed").alias("now"), "silent")  # gate is one row


@query("rule_r014_external_link", r"""
SELECT regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, count(*) AS links, min(page_id) AS first_page FROM pages GROUP BY 1""")
def rule_r014(spark: SparkSession, d: str) -> DataFrame:
    """Links grouped by the outside host they lead to."""
    return read(spark, d, "pages").groupBy(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1).alias("host")).agg(F.count("*").alias("links"), F.min("page_id").alias("first_page"))


@query("rule_r015_hidden_rows", """
SELECT l_orderkey, count(*) FILTER (WHERE l_linestatus = 'F') AS hidden, CAST(sum(CASE WHEN l_linestatus = 'F' THEN CAST(l_extendedprice AS DECIMAL(28,6)) ELSE 0 END) AS DOUBLE) AS contribution FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_linestatus = 'F') > 0""")
def rule_r015(spark: SparkSession, d: str) -> DataFrame:
    """Totals that contain hidden (finished) lines and what those add."""
    hidden = C("l_linestatus") == "F"
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(hidden).alias("hidden"), F.sum(F.when(hidden, C("l_extendedprice")).otherwise(0).cast("decimal(28,6)")).cast("double").alias("contribution")).filter("hidden > 0")


@query("audit_dedupe_group_rank", """
WITH f AS (SELECT l_orderkey AS sheet, l_linenumber AS col, l_returnflag AS rule, max(l_discount) AS confidence, max(l_extendedprice) AS impact FROM lineitem GROUP BY 1, 2, 3),
i AS (SELECT *, col - row_number() OVER (PARTITION BY sheet, rule ORDER BY col) AS island FROM f)
SELECT sheet, rule, min(col) AS first_col, max(col) AS last_col, count(*) AS cells, round(least(0.97, max(confidence) + 0.05 * (count(*) - 1)), 6) AS confidence, max(impact) AS impact FROM i GROUP BY sheet, rule, island""")
def audit_dedupe_group_rank(spark: SparkSession, d: str) -> DataFrame:
    """Findings: the most confident of each place, neighbours in one row as one finding."""
    x = dealt(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_discount", "l_extendedprice"), "l_orderkey")
    f = x.groupBy(C("l_orderkey").alias("sheet"), C("l_linenumber").alias("col"), C("l_returnflag").alias("rule")).agg(F.max("l_discount").alias("confidence"), F.max("l_extendedprice").alias("impact"))
    return FD.grouped(f, ["sheet", "rule"]).withColumn("confidence", F.round("confidence", 6))


@query("audit_price_diff", """
WITH b AS (SELECT o_orderpriority AS cell, CAST(sum(CAST(o_totalprice AS DECIMAL(28,6))) AS DOUBLE) AS v FROM orders GROUP BY 1), a AS (SELECT o_orderpriority AS cell, CAST(sum(CAST(o_totalprice AS DECIMAL(28,6))) AS DOUBLE) AS v FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT coalesce(b.cell, a.cell) AS cell, coalesce(b.v, 0) AS before, coalesce(a.v, 0) AS after, coalesce(a.v, 0) - coalesce(b.v, 0) AS delta, abs(coalesce(a.v, 0) - coalesce(b.v, 0)) * CASE WHEN coalesce(b.cell, a.cell) LIKE '1%' THEN 3 ELSE 1 END AS weighted FROM b FULL JOIN a ON a.cell = b.cell WHERE abs(coalesce(a.v, 0) - coalesce(b.v, 0)) > 1e-9 * greatest(1, abs(coalesce(a.v, 0)), abs(coalesce(b.v, 0)))""")
def audit_price_diff(spark: SparkSession, d: str) -> DataFrame:
    """What a fix changes: every cell that differs after it, currency cells weighted threefold."""
    total = lambda x: x.groupBy(C("o_orderpriority").alias("cell")).agg(F.sum(C("o_totalprice").cast("decimal(28,6)")).cast("double").alias("v"))
    o = read(spark, d, "orders")
    return FD.changes(total(o), total(o.filter("o_orderstatus <> 'F'")), ["cell"], C("cell").startswith("1"))


@query("guard_numbers", r"""
WITH n AS (SELECT item_id, unnest(regexp_extract_all(coalesce(text, ''), '[0-9]+(?:\.[0-9]+)?')) AS x FROM benchmark UNION ALL SELECT doc_id + 1000000, unnest(regexp_extract_all(coalesce(text, ''), '[0-9]+(?:\.[0-9]+)?')) FROM documents)
SELECT item_id, count(*) AS numbers, count(*) FILTER (WHERE NOT (CAST(x AS DOUBLE) BETWEEN 0 AND 100 AND CAST(x AS DOUBLE) = floor(CAST(x AS DOUBLE)))) AS unsupported FROM n GROUP BY 1""")
def guard_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers in texts that no evidence backs; whole numbers up to 100 need none."""
    x = read(spark, d, "benchmark").select("item_id", "text").unionByName(read(spark, d, "documents").select((C("doc_id") + 1000000).alias("item_id"), "text"))
    got = x.select("item_id", F.explode(guard.numbers_in(C("text"))).alias("x"))
    return got.groupBy("item_id").agg(F.count("*").alias("numbers"), F.count_if(~guard.always_allowed(C("x"))).alias("unsupported"))


@query("history_latest_run", """
SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS runs, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS latest FROM customer""")
def history_latest_run(spark: SparkSession, d: str) -> DataFrame:
    """Runs of each workbook and the latest one; one aggregate instead of a query for each workbook."""
    runs = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("runs"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))
    return read(spark, d, "customer").join(runs, C("c_custkey") == C("o_custkey"), "left").select("c_custkey", F.coalesce("runs", F.lit(0)).alias("runs"), "latest")


@query("history_summary", "SELECT count(DISTINCT o_custkey) AS workbooks, count(*) AS runs, count(*) FILTER (WHERE o_orderstatus = 'F') AS critical, CAST(max(o_orderdate) AS DATE) AS latest FROM orders")
def history_summary(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").agg(F.count_distinct("o_custkey").alias("workbooks"), F.count("*").alias("runs"), F.count_if(C("o_orderstatus") == "F").alias("critical"), F.to_date(F.max("o_orderdate")).alias("latest"))


@query("grid_preview_pivot", """
SELECT l_orderkey, max(l_quantity) FILTER (WHERE l_linenumber = 1) AS c1, max(l_quantity) FILTER (WHERE l_linenumber = 2) AS c2, max(l_quantity) FILTER (WHERE l_linenumber = 3) AS c3, max(l_quantity) FILTER (WHERE l_linenumber = 4) AS c4 FROM lineitem GROUP BY 1""")
def grid_preview_pivot(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "lineitem").groupBy("l_orderkey").pivot("l_linenumber", [1, 2, 3, 4]).agg(F.max("l_quantity"))
    return x.select("l_orderkey", *[C(str(i)).alias(f"c{i}") for i in range(1, 5)])
