"""Graph operators over the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafcalc.operators import graph
from sheafcalc.plans.registry import query
from sheafcalc.tables import read

C = F.col


def name(kind: str, key: str) -> Column:
    return F.concat(F.lit(kind), C(key).cast("string"))


def star_edges(spark: SparkSession, d: str) -> DataFrame:
    """region feeds nation feeds customer feeds order."""
    n, c, o = read(spark, d, "nation"), read(spark, d, "customer"), read(spark, d, "orders")
    parts = [n.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst")), c.select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst")), o.select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


EDGES_SQL = "SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders"


@query("graph_downstream", f"""
WITH RECURSIVE e AS ({EDGES_SQL}), w AS (SELECT 'r1' AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM w JOIN e ON src = node) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY 1""")
def graph_downstream(spark: SparkSession, d: str) -> DataFrame:
    """Everything that the first region feeds."""
    return graph.downstream(star_edges(spark, d), spark.createDataFrame([("r1",)], "node string"))


@query("graph_levels", f"""
WITH RECURSIVE e AS ({EDGES_SQL}), v AS (SELECT src AS node FROM e UNION SELECT dst FROM e), w AS (SELECT node, 0 AS level FROM v WHERE node NOT IN (SELECT dst FROM e) UNION SELECT dst, level + 1 FROM w JOIN e ON src = node) SELECT node, CAST(max(level) AS INTEGER) AS level FROM w GROUP BY 1""")
def graph_levels(spark: SparkSession, d: str) -> DataFrame:
    e = star_edges(spark, d)
    return graph.levels(e, e.select(F.explode(F.array("src", "dst")).alias("node")))[0]


PARTS_SQL = "SELECT p_partkey AS src, p_partkey - p_partkey % 5 + (p_partkey + p_size) % 5 AS dst FROM part"


@query("graph_cycles", f"""
WITH RECURSIVE e AS ({PARTS_SQL}), w AS (SELECT src AS root, dst AS node FROM e UNION SELECT root, dst FROM w JOIN e ON src = node)
SELECT a.root AS node, min(b.node) AS component FROM w a JOIN w b ON b.root = a.root JOIN w c ON c.root = b.node AND c.node = a.root WHERE a.node = a.root GROUP BY 1""")
def graph_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Strong components of a graph in which parts refer to another part each."""
    k = C("p_partkey")
    return graph.cycles(read(spark, d, "part").select(k.alias("src"), (k - k % 5 + (k + C("p_size")) % 5).alias("dst")))


@query("rule_r006_cycles", f"""
WITH RECURSIVE e AS ({PARTS_SQL}), w AS (SELECT src AS root, dst AS node FROM e UNION SELECT root, dst FROM w JOIN e ON src = node),
s AS (SELECT a.root AS node, min(b.node) AS component FROM w a JOIN w b ON b.root = a.root JOIN w c ON c.root = b.node AND c.node = a.root WHERE a.node = a.root GROUP BY 1)
SELECT component, count(*) AS cells FROM s GROUP BY 1""")
def rule_r006(spark: SparkSession, d: str) -> DataFrame:
    """One finding for each cycle, with its size."""
    return graph_cycles(spark, d).groupBy("component").agg(F.count("*").alias("cells"))


@query("graph_trace", f"""
WITH RECURSIVE e AS ({EDGES_SQL}), w AS (SELECT 'o7' AS node, 0 AS depth UNION SELECT src, depth + 1 FROM w JOIN e ON dst = node WHERE depth < 6) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY 1""")
def graph_trace(spark: SparkSession, d: str) -> DataFrame:
    """Where an order's value comes from."""
    return graph.trace(star_edges(spark, d), spark.createDataFrame([("o7",)], "node string"))


@query("join_interval_containment", """
WITH r AS (SELECT p_brand, min(p_size) AS lo, max(p_size) - 20 AS hi FROM part GROUP BY 1) SELECT p_brand, count(*) AS inside FROM r JOIN (SELECT p_size AS s, p_partkey FROM part) ON s BETWEEN lo AND hi GROUP BY 1""")
def join_interval_containment(spark: SparkSession, d: str) -> DataFrame:
    """Cells inside rectangles: rows are cut into bands of 8, so that the join has a key."""
    p = read(spark, d, "part")
    r = p.groupBy("p_brand").agg(F.min("p_size").alias("lo"), (F.max("p_size") - 20).alias("hi")).filter("lo <= hi")
    r = r.withColumn("band", F.explode(F.sequence(F.floor(C("lo") / 8), F.floor(C("hi") / 8))))
    # Parts of one size are counted before they meet the rectangles.
    s = p.groupBy(C("p_size").alias("s")).agg(F.count("*").alias("n")).withColumn("band", F.floor(C("s") / 8))
    return r.join(s, "band").filter("s BETWEEN lo AND hi").groupBy("p_brand").agg(F.sum("n").alias("inside"))


@query("window_growth_chain", """
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, first_value(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS base FROM orders)
SELECT o_custkey, o_orderkey, round(base * pow(1.02, i - 1), 2) AS projected FROM r""")
def window_growth_chain(spark: SparkSession, d: str) -> DataFrame:
    """A chain of cells that each grow by 2 % from the one before, in closed form."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    x = read(spark, d, "orders").withColumn("i", F.row_number().over(w)).withColumn("base", F.first("o_totalprice").over(w))
    return x.select("o_custkey", "o_orderkey", F.round(C("base") * F.pow(F.lit(1.02), C("i") - 1), 2).alias("projected"))


@query("setop_changed_keys", """
(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0""")
def setop_changed_keys(spark: SparkSession, d: str) -> DataFrame:
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    both = o.filter("o_orderstatus = 'O'").select(C("o_custkey").alias("k")).intersect(o.filter("o_orderstatus = 'F'").select("o_custkey"))
    return both.exceptAll(c.filter("c_acctbal < 0").select("c_custkey"))
