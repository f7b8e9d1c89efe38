"""Worksheet functions over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheafcalc.functions import aggregates as A
from sheafcalc.functions import lookups as L
from sheafcalc.functions import scalar as S
from sheafcalc.functions import values as V
from sheafcalc.plans.registry import query
from sheafcalc.tables import read

C = F.col


def lines():
    """Lines of an order in a fixed order."""
    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("fn_sum_avg_min_max", """
SELECT l_returnflag, CAST(sum(CAST(l_quantity AS DECIMAL(28,6))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(28,6))) AS DOUBLE) AS sum_price,
 round(CAST(sum(CAST(l_extendedprice AS DECIMAL(28,6))) AS DOUBLE) / count(*), 6) AS avg_price, min(l_discount) AS min_disc, max(l_tax) AS max_tax FROM lineitem GROUP BY 1""")
def fn_sum_avg_min_max(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "lineitem")
    return x.groupBy("l_returnflag").agg(A.sum_(C("l_quantity")).alias("sum_qty"), A.sum_(C("l_extendedprice")).alias("sum_price"), F.round(A.average(C("l_extendedprice")).value, 6).alias("avg_price"), A.min_(C("l_discount")).alias("min_disc"), A.max_(C("l_tax")).alias("max_tax"))


@query("fn_count_family", """
SELECT event_type, count(CASE WHEN value > 50 THEN value END) AS n_count, count(props) AS n_counta, count(*) FILTER (WHERE value <= 50 OR value IS NULL) AS n_blank FROM events GROUP BY 1""")
def fn_count_family(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "events").withColumn("cell", F.when(C("value") > 50, C("value")))
    return x.groupBy("event_type").agg(A.count(C("cell")).alias("n_count"), A.counta(C("props")).alias("n_counta"), A.countblank(C("cell")).alias("n_blank"))


@query("fn_product_median_stdev", """
SELECT l_returnflag, l_linestatus, round(exp(sum(ln(1 + l_discount / 1000))), 3) AS growth, median(l_extendedprice) AS mid_price, round(stddev_samp(l_quantity), 6) AS sd_qty FROM lineitem GROUP BY 1, 2""")
def fn_product_median_stdev(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "lineitem")
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.round(A.product(1 + C("l_discount") / 1000), 3).alias("growth"), A.median(C("l_extendedprice")).value.alias("mid_price"), F.round(A.stdev(C("l_quantity")).value, 6).alias("sd_qty"))


@query("fn_large_small", """
WITH r AS (SELECT c_mktsegment, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) AS hi, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) AS lo FROM customer)
SELECT c_mktsegment, max(c_acctbal) FILTER (WHERE hi = 3) AS third_largest, max(c_acctbal) FILTER (WHERE lo = 2) AS second_smallest FROM r GROUP BY 1""")
def fn_large_small(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "customer")
    hi, lo = A.kth(x, ["c_mktsegment"], "c_acctbal", 3), A.kth(x, ["c_mktsegment"], "c_acctbal", 2, largest=False)
    return hi.select("c_mktsegment", C("value").alias("third_largest")).join(lo.select("c_mktsegment", C("value").alias("second_smallest")), "c_mktsegment")


@query("fn_countif_ops", """
SELECT c_mktsegment, count(*) FILTER (WHERE c_acctbal > 1000) AS gt, count(*) FILTER (WHERE c_acctbal >= 1000) AS ge, count(*) FILTER (WHERE c_acctbal < 0) AS lt, count(*) FILTER (WHERE c_acctbal <= 0) AS le,
 count(*) FILTER (WHERE c_nationkey = 7) AS eq, count(*) FILTER (WHERE c_nationkey <> 7) AS ne, count(*) FILTER (WHERE c_name ILIKE '%7_') AS wild FROM customer GROUP BY 1""")
def fn_countif_ops(spark: SparkSession, d: str) -> DataFrame:
    m = lambda c, crit, text=False: A.countif(A.matches(C(c), crit, text))
    return read(spark, d, "customer").groupBy("c_mktsegment").agg(m("c_acctbal", ">1000").alias("gt"), m("c_acctbal", ">=1000").alias("ge"), m("c_acctbal", "<0").alias("lt"), m("c_acctbal", "<=0").alias("le"), m("c_nationkey", 7).alias("eq"), m("c_nationkey", "<>7").alias("ne"), m("c_name", "*7?", True).alias("wild"))


@query("fn_sumif_averageif", """
SELECT l_linestatus, CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(28,6)) ELSE 0 END) AS DOUBLE) AS returned,
 round(CAST(sum(CASE WHEN l_discount >= 0.05 THEN CAST(l_quantity AS DECIMAL(28,6)) END) AS DOUBLE) / count(CASE WHEN l_discount >= 0.05 THEN 1 END), 6) AS avg_qty FROM lineitem GROUP BY 1""")
def fn_sumif_averageif(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy("l_linestatus").agg(A.sumif(A.matches(C("l_returnflag"), "r", True), C("l_extendedprice")).alias("returned"), F.round(A.averageif(A.matches(C("l_discount"), ">=0.05", False), C("l_quantity")).value, 6).alias("avg_qty"))


@query("fn_sumifs_matrix", """
SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'O' AND o_totalprice > 100000) AS n, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(28,6))) FILTER (WHERE o_orderstatus = 'O' AND o_totalprice > 100000), 0) AS DOUBLE) AS total,
 coalesce(max(o_totalprice) FILTER (WHERE o_orderstatus = 'O' AND o_totalprice > 100000), 0) AS most, coalesce(min(o_totalprice) FILTER (WHERE o_orderstatus = 'O' AND o_totalprice > 100000), 0) AS least FROM orders GROUP BY 1""")
def fn_sumifs_matrix(spark: SparkSession, d: str) -> DataFrame:
    w, x = A.matches(C("o_orderstatus"), "=O", True) & A.matches(C("o_totalprice"), ">100000", False), C("o_totalprice")
    return read(spark, d, "orders").groupBy("o_orderpriority").agg(A.countif(w).alias("n"), A.sumif(w, x).alias("total"), A.maxifs(w, x).alias("most"), A.minifs(w, x).alias("least"))


@query("fn_sumproduct", """
SELECT l_linestatus, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(28,6))) AS DOUBLE) AS net, CAST(sum(CAST(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END AS DECIMAL(28,6))) AS DOUBLE) AS flagged FROM lineitem GROUP BY 1""")
def fn_sumproduct(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy("l_linestatus").agg(A.sumproduct(C("l_extendedprice"), 1 - C("l_discount")).alias("net"), A.sumproduct((C("l_returnflag") == "R").cast("double"), C("l_extendedprice")).alias("flagged"))


@query("fn_vlookup_exact", """
SELECT c_custkey, n_name AS nation, CASE WHEN n_nationkey IS NULL THEN '#N/A' END AS nation_error FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) n ON c_nationkey = n_nationkey""")
def fn_vlookup_exact(spark: SparkSession, d: str) -> DataFrame:
    out = L.vlookup(read(spark, d, "customer").select("c_custkey", "c_nationkey"), C("c_nationkey"), read(spark, d, "nation").filter("n_nationkey < 20"), "n_nationkey", "n_name", "n_name", "nation")
    return out.select("c_custkey", "nation", "nation_error")


BANDS = "(VALUES (0.0, 'tiny'), (1000.0, 'small'), (1300.0, 'mid'), (1600.0, 'large'), (1900.0, 'huge')) b(low, band)"


def bands(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES (0.0D, 'tiny'), (1000.0D, 'small'), (1300.0D, 'mid'), (1600.0D, 'large'), (1900.0D, 'huge') AS b(low, band)")


@query("fn_vlookup_approx", f"SELECT p_partkey, (SELECT max_by(band, low) FROM {BANDS} WHERE low <= p_retailprice) AS band FROM part")
def fn_vlookup_approx(spark: SparkSession, d: str) -> DataFrame:
    return L.nearest(read(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", bands(spark), "low", "band", "band").drop("p_retailprice")


@query("fn_xlookup_next_larger", f"SELECT p_partkey, (SELECT min_by(band, low) FROM {BANDS} WHERE low >= p_retailprice) AS band FROM part")
def fn_xlookup_next_larger(spark: SparkSession, d: str) -> DataFrame:
    return L.nearest(read(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", bands(spark), "low", "band", "band", larger=True).drop("p_retailprice")


@query("fn_asof_events", """
WITH e AS (SELECT event_id, user_id, ts, event_type FROM events), p AS (SELECT DISTINCT ts FROM events WHERE event_type = 'purchase')
SELECT event_id, (epoch_us(p.ts) - epoch_us(TIMESTAMP '1970-01-01')) AS last_us FROM e ASOF LEFT JOIN p ON e.ts >= p.ts""")
def fn_asof_events(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "events").withColumn("us", F.unix_micros(C("ts").cast("timestamp")))
    keys = x.filter("event_type = 'purchase'").select("us", C("us").alias("last_us")).distinct()
    return L.nearest(x.select("event_id", "us"), "us", keys, "us", "last_us", "last_us").drop("us")


@query("fn_match_modes", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos FROM lineitem)
SELECT l_orderkey, min(pos) FILTER (WHERE l_returnflag = 'R') AS first_r, max(pos) FILTER (WHERE l_quantity <= 25) AS last_le, max(pos) FILTER (WHERE l_quantity >= 25) AS last_ge FROM r GROUP BY 1""")
def fn_match_modes(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "lineitem").withColumn("pos", F.row_number().over(lines()).cast("long"))
    return x.groupBy("l_orderkey").agg(F.min(F.when(C("l_returnflag") == "R", C("pos"))).alias("first_r"), F.max(F.when(C("l_quantity") <= 25, C("pos"))).alias("last_le"), F.max(F.when(C("l_quantity") >= 25, C("pos"))).alias("last_ge"))


@query("fn_index", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos FROM lineitem)
SELECT o_orderkey, max(CASE WHEN pos = 3 THEN l_extendedprice END) AS third, CASE WHEN max(CASE WHEN pos = 3 THEN 1 END) IS NULL THEN '#REF!' END AS third_error FROM orders LEFT JOIN r ON o_orderkey = l_orderkey GROUP BY 1""")
def fn_index(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "lineitem").withColumn("pos", F.row_number().over(lines())).filter("pos = 3").select(C("l_orderkey").alias("o_orderkey"), C("l_extendedprice").alias("third"))
    return read(spark, d, "orders").select("o_orderkey").join(x, "o_orderkey", "left").withColumn("third_error", F.when(C("third").isNull(), V.REF))


@query("fn_hlookup", """
SELECT p_partkey, CASE WHEN p_size <= 25 THEN 'size' ELSE 'retail' END AS field, CASE WHEN p_size <= 25 THEN CAST(p_size AS DOUBLE) ELSE p_retailprice END AS value FROM part""")
def fn_hlookup(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "part").select("p_partkey", "p_size", C("p_size").cast("double").alias("size"), C("p_retailprice").alias("retail"))
    want = F.when(C("p_size") <= 25, "size").otherwise("retail")
    return x.unpivot(["p_partkey", "p_size"], ["size", "retail"], "field", "value").filter(C("field") == want).drop("p_size")


@query("fn_if_ifs_switch_choose", """
SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'big' ELSE 'small' END AS size, CASE WHEN o_totalprice > 300000 THEN 3 WHEN o_totalprice > 150000 THEN 2 WHEN o_totalprice > 50000 THEN 1 END AS tier,
 CASE WHEN o_totalprice > 50000 THEN NULL ELSE '#N/A' END AS tier_error, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE 'other' END AS status, CASE o_orderkey % 4 WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'c' END AS pick FROM orders""")
def fn_if_ifs_switch_choose(spark: SparkSession, d: str) -> DataFrame:
    t, s = C("o_totalprice"), C("o_orderstatus")
    tier = S.ifs((t > 300000, F.lit(3)), (t > 150000, F.lit(2)), (t > 50000, F.lit(1)))
    status = S.switch(s, (F.lit("O"), F.lit("open")), (F.lit("F"), F.lit("filled")), default=F.lit("other"))
    return read(spark, d, "orders").select("o_orderkey", F.when(t > 150000, "big").otherwise("small").alias("size"), tier.value.alias("tier"), tier.error.alias("tier_error"), status.value.alias("status"), S.choose(C("o_orderkey") % 4, F.lit("a"), F.lit("b"), F.lit("c")).value.alias("pick"))


@query("fn_bool_logic", """
SELECT l_orderkey, bool_and(l_quantity > 5) AS all_over, bool_or(l_discount = 0) AS any_free, NOT bool_or(l_returnflag = 'R') AS none_returned FROM lineitem GROUP BY 1""")
def fn_bool_logic(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_and(C("l_quantity") > 5).alias("all_over"), F.bool_or(C("l_discount") == 0).alias("any_free"), (~F.bool_or(C("l_returnflag") == "R")).alias("none_returned"))


@query("fn_iferror_ifna", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_discount = 0 THEN -1 ELSE round(l_tax / l_discount, 6) END AS ratio, CASE WHEN l_discount = 0 THEN '#DIV/0!' END AS code FROM lineitem""")
def fn_iferror_ifna(spark: SparkSession, d: str) -> DataFrame:
    q = S.divide(C("l_tax"), C("l_discount"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", V.iferror(q.then(lambda v: F.round(v, 6)), F.lit(-1.0)).alias("ratio"), V.ifna(q, F.lit(0.0)).error.alias("code"))


@query("fn_type_tests", """
WITH p AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN regexp_extract(props, '[0-9]+') ELSE event_type END AS cell FROM events)
SELECT event_id, cell IS NULL AS is_blank, coalesce(TRY_CAST(cell AS DOUBLE) IS NOT NULL, false) AS is_number, cell IS NOT NULL AND TRY_CAST(cell AS DOUBLE) IS NULL AS is_text, coalesce(TRY_CAST(cell AS DOUBLE), 0) AS n FROM p""")
def fn_type_tests(spark: SparkSession, d: str) -> DataFrame:
    cell = F.when(C("event_id") % 3 == 0, None).when(C("event_id") % 3 == 1, F.regexp_extract("props", "[0-9]+", 0)).otherwise(C("event_type"))
    x = read(spark, d, "events").select("event_id", cell.alias("cell"))
    number = V.to_number(C("cell"))
    is_number = C("cell").isNotNull() & ~V.iserror(number)
    return x.select("event_id", C("cell").isNull().alias("is_blank"), is_number.alias("is_number"), (C("cell").isNotNull() & ~is_number).alias("is_text"), F.when(is_number, number.value).otherwise(0.0).alias("n"))


@query("fn_rounding", """
WITH x AS (SELECT c_custkey, CAST(c_acctbal AS DECIMAL(28,10)) AS a, c_acctbal AS b FROM customer)
SELECT c_custkey, round(a, 1)::DOUBLE AS r, (sign(a) * ceil(abs(a) * 10) / 10)::DOUBLE AS up, (sign(a) * floor(abs(a) * 10) / 10)::DOUBLE AS down, floor(b)::BIGINT AS whole, ceil(b / 25 - 1e-12) * 25 + 0.0 AS ceil25, floor(b / 25 + 1e-12) * 25 AS floor25, sign(b)::DOUBLE AS sgn, abs(b) AS size FROM x""")
def fn_rounding(spark: SparkSession, d: str) -> DataFrame:
    b = C("c_acctbal")
    return read(spark, d, "customer").select("c_custkey", F.round(b, 1).alias("r"), S.roundup(b, 1).alias("up"), S.rounddown(b, 1).alias("down"), F.floor(b).alias("whole"), (S.ceiling(b, F.lit(25.0)).value + 0.0).alias("ceil25"), S.floor(b, F.lit(25.0)).value.alias("floor25"), F.signum(b).alias("sgn"), F.abs(b).alias("size"))


@query("fn_mod_power_sqrt", """
SELECT c_custkey, round(c_acctbal - 7 * floor(c_acctbal / 7), 6) AS m, round(pow(c_nationkey, 1.5), 6) AS p, CASE WHEN c_acctbal < 0 THEN NULL ELSE round(sqrt(abs(c_acctbal)), 6) END AS s, CASE WHEN c_acctbal < 0 THEN '#NUM!' END AS s_error FROM customer""")
def fn_mod_power_sqrt(spark: SparkSession, d: str) -> DataFrame:
    s = S.sqrt(C("c_acctbal"))
    return read(spark, d, "customer").select("c_custkey", F.round(S.mod(C("c_acctbal"), F.lit(7.0)).value, 6).alias("m"), F.round(S.power(C("c_nationkey").cast("double"), F.lit(1.5)).value, 6).alias("p"), F.round(s.value, 6).alias("s"), s.error.alias("s_error"))


@query("fn_text_slice", """
SELECT p_partkey, left(p_name, 4) AS l, right(p_name, 3) AS r, substr(p_name, 3, 5) AS m, length(p_name) AS n, upper(p_type) AS u, lower(p_brand) AS w, trim(regexp_replace('  ' || p_name || '  x ', '\\s+', ' ', 'g')) AS t FROM part""")
def fn_text_slice(spark: SparkSession, d: str) -> DataFrame:
    n = C("p_name")
    return read(spark, d, "part").select("p_partkey", F.left(n, F.lit(4)).alias("l"), F.right(n, F.lit(3)).alias("r"), S.mid(n, F.lit(3), F.lit(5)).value.alias("m"), F.char_length(n).cast("long").alias("n"), F.upper("p_type").alias("u"), F.lower("p_brand").alias("w"), S.trim(F.concat(F.lit("  "), n, F.lit("  x "))).alias("t"))


@query("fn_text_edit", """
SELECT p_partkey, replace(p_brand, '#', '-') AS s, left(p_name, 1) || 'ZZ' || substr(p_name, 4) AS r, repeat(left(p_brand, 1), 3) AS t, p_brand || '|' || p_type AS c, upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS p FROM part WHERE NOT regexp_matches(p_type, '[^A-Za-z]')""")
def fn_text_edit(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "part").filter(~C("p_type").rlike("[^A-Za-z]"))
    return x.select("p_partkey", S.substitute(C("p_brand"), "#", "-").alias("s"), S.replace_at(C("p_name"), 2, 2, "ZZ").alias("r"), S.rept(F.left("p_brand", F.lit(1)), F.lit(3)).value.alias("t"), F.concat_ws("|", "p_brand", "p_type").alias("c"), S.proper(C("p_type")).alias("p"))


@query("fn_text_search", """
SELECT p_partkey, CASE WHEN strpos(p_name, 'a') > 0 THEN CAST(strpos(p_name, 'a') AS DOUBLE) END AS f, CASE WHEN strpos(p_name, 'a') = 0 THEN '#VALUE!' END AS f_error, CASE WHEN strpos(lower(p_name), 'a') > 0 THEN CAST(strpos(lower(p_name), 'a') AS DOUBLE) END AS s FROM part""")
def fn_text_search(spark: SparkSession, d: str) -> DataFrame:
    f = S.find(F.lit("a"), C("p_name"))
    return read(spark, d, "part").select("p_partkey", f.value.alias("f"), f.error.alias("f_error"), S.search(F.lit("A"), C("p_name")).value.alias("s"))


@query("fn_text_join", """
SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1""")
def fn_text_join(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), ", ").alias("names"))


@query("fn_text_value", """
SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS t, printf('%.1f', round(o_totalprice / 1000, 1)) AS k, round(o_totalprice, 2) AS back FROM orders""")
def fn_text_value(spark: SparkSession, d: str) -> DataFrame:
    t = S.text(C("o_totalprice"), "#,##0.00")
    return read(spark, d, "orders").select("o_orderkey", t.alias("t"), S.text(C("o_totalprice") / 1000, "0.0").alias("k"), S.value(t).value.alias("back"))


@query("fn_date_parts", """
SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd, hour(o_orderdate) AS h, minute(o_orderdate) AS mi, dayofweek(o_orderdate) + 1 AS w1, (dayofweek(o_orderdate) + 6) % 7 + 1 AS w2, (dayofweek(o_orderdate) + 6) % 7 AS w3, CAST(date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS DOUBLE) AS serial FROM orders""")
def fn_date_parts(spark: SparkSession, d: str) -> DataFrame:
    t = C("o_orderdate").cast("timestamp")
    n = lambda c: c.cast("long")
    return read(spark, d, "orders").select("o_orderkey", n(F.year(t)).alias("y"), n(F.month(t)).alias("m"), n(F.dayofmonth(t)).alias("dd"), n(F.hour(t)).alias("h"), n(F.minute(t)).alias("mi"), n(S.weekday(t)).alias("w1"), n(S.weekday(t, 2)).alias("w2"), n(S.weekday(t, 3)).alias("w3"), V.serial(t).alias("serial"))


@query("fn_date_math", """
WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, DATE '2001-05-31' AS b FROM orders)
SELECT o_orderkey, CAST(a + INTERVAL 1 MONTH AS DATE) AS edate, last_day(CAST(date_trunc('month', a) + INTERVAL 2 MONTH AS DATE)) AS eomonth, date_diff('day', a, b) AS days,
 CASE WHEN b >= a THEN CAST((year(b) - year(a)) * 12 + month(b) - month(a) - CASE WHEN day(b) < day(a) THEN 1 ELSE 0 END AS DOUBLE) END AS months, make_date(CAST(year(a) + 1 AS INTEGER), 2, 1) AS rolled FROM x""")
def fn_date_math(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.to_date("o_orderdate"), F.to_date(F.lit("2001-05-31"))
    return read(spark, d, "orders").select("o_orderkey", S.edate(a, F.lit(1)).alias("edate"), S.eomonth(a, F.lit(2)).alias("eomonth"), F.date_diff(b, a).cast("long").alias("days"), S.datedif(a, b, "M").value.alias("months"), S.date(F.year(a), F.lit(14), F.lit(1)).alias("rolled"))


@query("fn_npv_by_customer", """
WITH r AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders)
SELECT o_custkey, round(sum(o_totalprice / pow(1.01, i)), 2) AS npv FROM r GROUP BY 1""")
def fn_npv_by_customer(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "orders").withColumn("i", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    return x.groupBy("o_custkey").agg(F.round(A.npv(0.01, C("o_totalprice"), C("i")), 2).alias("npv"))


@query("fn_irr")
def fn_irr(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer as flows after paying nine tenths of their sum; bisection has no short SQL, so a test checks it."""
    x = read(spark, d, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_totalprice"))), lambda r: r["o_totalprice"]).alias("got"))
    flows = F.concat(F.array(-0.9 * F.aggregate("got", F.lit(0.0), lambda a, v: a + v)), C("got"))
    r = S.irr(flows)
    return x.select("o_custkey", F.round(r.value, 6).alias("irr"), r.error.alias("irr_error"))


@query("fn_annuity", """
WITH g AS (SELECT c_custkey, 0.01 + (c_custkey % 5) / 100.0 AS r, pow(1.01 + (c_custkey % 5) / 100.0, 12) AS g, c_acctbal AS p FROM customer)
SELECT c_custkey, round(-r * p * g / (g - 1), 4) AS pmt, round(-(100 * (g - 1) / r) / g, 4) AS pv, round(-(p * g + 100 * (g - 1) / r), 4) AS fv FROM g""")
def fn_annuity(spark: SparkSession, d: str) -> DataFrame:
    r, n, p = 0.01 + (C("c_custkey") % 5) / 100.0, F.lit(12.0), C("c_acctbal")
    return read(spark, d, "customer").select("c_custkey", F.round(S.pmt(r, n, p).value, 4).alias("pmt"), F.round(S.pv(r, n, F.lit(100.0)), 4).alias("pv"), F.round(S.fv(r, n, F.lit(100.0), p), 4).alias("fv"))


@query("op_compare_order", """
WITH m AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value END AS n, CASE WHEN event_id % 3 = 1 THEN event_type END AS s, CASE WHEN event_id % 3 = 2 THEN value > 50 END AS b FROM events)
SELECT event_id, rank() OVER (ORDER BY CASE WHEN b IS NOT NULL THEN 2 WHEN s IS NOT NULL THEN 1 ELSE 0 END, coalesce(n, 0), upper(s), b) AS place FROM m""")
def op_compare_order(spark: SparkSession, d: str) -> DataFrame:
    """The order of mixed values; ranks inside blocks of the order and the sizes of the blocks before, not one sort in one task."""
    i = C("event_id")
    x = read(spark, d, "events").select("event_id", F.when(i % 3 == 0, C("value")).alias("n"), F.when(i % 3 == 1, C("event_type")).alias("s"), F.when(i % 3 == 2, C("value") > 50).alias("b"))
    x = x.withColumn("key", V.sort_key(C("n"), C("s"), C("b")))
    # A block is a rank and the whole part of a number, in the order of the key.
    x = x.withColumn("block", F.struct(C("key.rank"), F.floor("key.n").alias("n")))
    sizes = x.groupBy("block").agg(F.count("*").alias("rows")).withColumn("before", F.coalesce(F.sum("rows").over(Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.rank().over(Window.partitionBy("block").orderBy("key"))
    return x.withColumn("inside", inside).join(sizes, "block").select("event_id", (C("before") + C("inside")).cast("long").alias("place"))


@query("op_broadcast_percent_concat", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(l_extendedprice * 1.1 - 5, 6) AS scaled, l_quantity / 100 AS pct, l_returnflag || '-' || l_linestatus AS tag FROM lineitem""")
def op_broadcast_percent_concat(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.round(C("l_extendedprice") * 1.1 - 5, 6).alias("scaled"), (C("l_quantity") / 100).alias("pct"), F.concat_ws("-", "l_returnflag", "l_linestatus").alias("tag"))
