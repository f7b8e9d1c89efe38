"""Mixing sources to target weights by hierarchical budgets over a tree of domain, language and source.

The token budget of the root is shared among its children by weight, and so on down to the leaves. No
child gets more than it can give (its tokens times the epochs allowed); what a child cannot take goes to
its siblings by weight, and only what all siblings together cannot take would go up, which a parent's own
bound, the sum over its children, settles one level higher in the same way. Every leaf then gives whole
seeded epochs, and of the last epoch the rows at the front of its seeded order whose tokens still fit.

All shares are whole-number arithmetic, so results do not depend on the order of sums. Null domains,
languages and sources are leaves under the empty name; null and empty texts have no tokens and come with
every whole epoch and with the front of the last one; rows of one leaf and id share a place in the order
and are taken together or not at all. An empty table, or a budget of 0, gives no copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafcalc.llm.common import stored

#: Production parameters: tokens wanted per 1000 there are, epochs at most, seed, rows of a bin of the seeded order.
SHARE, EPOCHS, SEED, BIN_ROWS = 800, 3, 17, 4096
#: Weights in parts per thousand; a name without one has the default.
DOMAIN_WEIGHTS = {"web": 500, "forum": 300, "reference": 200}
LANG_WEIGHTS = {"en": 400, "de": 250, "fr": 200, "es": 150}
DEFAULT_WEIGHT = 100
LEVELS = ("domain", "lang", "source")


def default_domain() -> Column:
    """A domain for each source: by its number, the remainder modulo 3 says web, forum or reference."""
    number = F.expr("coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]{1,9})', 1) as bigint), 0)")
    return F.element_at(F.array(*map(F.lit, DOMAIN_WEIGHTS)), (number % 3 + 1).cast("int"))


def weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(DEFAULT_WEIGHT)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("decimal(38,0)")


def shares(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Share `budget` of each parent among its children by weight `w`, each at most `cap`: the water level of
    a group is found in order of cap over w, where all children before it are full."""
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    # cap / w < cap' / w' for whole numbers; decimals hold the ratio far beyond the spread of tokens.
    order = by.orderBy((F.col("cap").cast("decimal(38,12)") / F.col("w").cast("decimal(10,0)")).alias("r"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    out = nodes.withColumn("caps", F.coalesce(F.sum("cap").over(before), F.lit(0)).cast("decimal(20,0)")).withColumn("ws", (F.sum("w").over(by) - F.coalesce(F.sum("w").over(before), F.lit(0))).cast("decimal(12,0)"))
    left = (F.greatest(F.col("budget") - F.col("caps"), F.lit(0))).cast("decimal(20,0)")
    full = left * F.col("w").cast("decimal(10,0)") >= F.col("cap").cast("decimal(20,0)") * F.col("ws")
    out = out.withColumn("left", left).withColumn("open", ~full)
    first = F.min(F.when(F.col("open"), F.struct("caps", "left", "ws"))).over(by)
    out = out.withColumn("level", first)
    given = F.when(~F.col("open"), F.col("cap")).otherwise(F.expr("(level.left * cast(w as decimal(10,0))) div level.ws"))
    return out.withColumn("budget", given.cast("bigint")).drop("caps", "ws", "left", "open", "level")


def leaf_budgets(sized: DataFrame, weights: dict[str, dict[str, int]], share: int, epochs: int) -> DataFrame:
    """domain, lang, source, tokens, n_rows and budget of each leaf."""
    leaves = sized.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_rows")).withColumn("cap", F.col("tokens") * epochs)
    budgets, parent = None, []
    for level in LEVELS:
        here = [*parent, level]
        nodes = leaves.groupBy(*here).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
        if budgets is None:
            everything = Window.partitionBy(F.lit(0))
            nodes = nodes.withColumn("budget", F.expr("cast(tokens as bigint)")).withColumn("budget", F.sum("budget").over(everything) * share).withColumn("budget", F.expr("budget div 1000"))
        else:
            nodes = nodes.join(budgets, parent)
        nodes = shares(nodes.drop("tokens").withColumn("w", weight(level, weights)), parent, level)
        budgets, parent = nodes.select(*here, "budget"), here
    return leaves.drop("cap").join(budgets, list(LEVELS))


def mix(docs: DataFrame, domain: Column | None = None, weights: dict[str, dict[str, int]] | None = None, share: int = SHARE, epochs: int = EPOCHS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", bin_rows: int = BIN_ROWS) -> DataFrame:
    """id, domain, lang, source, n_tokens and n_copies (how often the row is taken) for each row of docs."""
    weights = weights if weights is not None else {"domain": DOMAIN_WEIGHTS, "lang": LANG_WEIGHTS}
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    sized = docs.select(F.col(id_col).alias("id"), (domain if domain is not None else default_domain()).alias("domain"), blank("lang").alias("lang"), blank("source").alias("source"), F.coalesce(F.expr(f"regexp_count({text_col}, '[^\\\\x20\\\\x09-\\\\x0D]+')"), F.lit(0)).cast("bigint").alias("n_tokens"))
    sized = stored(sized.withColumn("domain", F.coalesce("domain", F.lit(""))))  # read several times below
    leaves = leaf_budgets(sized, weights, share, epochs)
    leaves = leaves.withColumn("whole", F.expr("if(tokens > 0, budget div tokens, 0)")).withColumn("part", F.expr("if(tokens > 0, budget % tokens, 0)"))
    # Bins of the seeded order: about bin_rows rows each, so that no leaf is sorted in one task.
    leaves = leaves.withColumn("bins", F.least(F.lit(65536), F.greatest(F.lit(1), F.expr(f"n_rows div {bin_rows}"))).cast("int"))
    leaves = stored(leaves)
    n_leaves = leaves.count()
    hint = F.broadcast if n_leaves <= 100_000 else (lambda x: x)
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    rows = sized.join(hint(leaves), list(LEVELS)).withColumn("key", key)
    rows = rows.withColumn("bin", F.expr("(cast(conv(substr(key, 1, 4), 16, 10) as bigint) * bins) div 65536"))
    sums = rows.groupBy(*LEVELS, "bin").agg(F.sum("n_tokens").alias("bin_tokens"), F.max("part").alias("part"))
    run = Window.partitionBy(*LEVELS).orderBy("bin")
    bins = sums.withColumn("ahead", F.sum("bin_tokens").over(run) - F.col("bin_tokens")).select(*LEVELS, "bin", "ahead", (F.col("ahead") + F.col("bin_tokens") <= F.col("part")).alias("all_in"), (F.col("ahead") > F.col("part")).alias("out"))
    # Only the one bin of each leaf where the budget ends is ordered row by row.
    edge = hint(bins.filter("NOT all_in AND NOT out").groupBy(*LEVELS).agg(F.min_by("bin", "bin").alias("edge"), F.min("ahead").alias("ahead")))
    marked = rows.join(edge, list(LEVELS), "left")
    here = Window.partitionBy(*LEVELS).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    on_edge = marked.filter("bin = edge").withColumn("taken", (F.col("ahead") + F.sum("n_tokens").over(here) <= F.col("part")))
    others = marked.filter("edge IS NULL OR bin <> edge").withColumn("taken", F.expr("edge IS NULL OR bin < edge"))
    both = on_edge.unionByName(others)
    copies = (F.col("whole") + F.when(F.col("taken") & (F.col("part") > 0), 1).otherwise(0)).cast("bigint")
    return both.select(F.col("id").alias(id_col), *LEVELS, "n_tokens", copies.alias("n_copies"))


def level_sql(nodes: str, parent: str, name: str) -> str:
    """SQL of shares() over a relation with cap, w and budget."""
    by = f"PARTITION BY {parent}" if parent else ""
    keys = f"{parent}, " if parent else ""
    return f"""(WITH a AS (SELECT *, coalesce(sum(cap) OVER (x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
  sum(w) OVER ({by}) - coalesce(sum(w) OVER (x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ws
  FROM {nodes} WINDOW x AS ({by} ORDER BY cap / w, {name})),
b AS (SELECT *, greatest(budget - caps, 0) AS rest, greatest(budget - caps, 0) * w < cap * ws AS free FROM a),
c AS (SELECT *, min(CASE WHEN free THEN caps END) OVER ({by}) AS c0, max(CASE WHEN free THEN ws END) OVER ({by}) AS w0 FROM b)
SELECT {keys}{name}, CAST(CASE WHEN free THEN (greatest(budget - c0, 0) * w) // w0 ELSE cap END AS BIGINT) AS budget FROM c)"""


def oracle_sql() -> str:
    """DuckDB SQL for mix() with the production parameters over documents."""
    case = lambda level, ws: "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in ws.items()) + f" ELSE {DEFAULT_WEIGHT} END"
    names = ", ".join(f"'{x}'" for x in DOMAIN_WEIGHTS)
    leaf = ", ".join(LEVELS)
    return f"""
WITH s AS (SELECT doc_id, [{names}][1 + coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})', 1) AS BIGINT), 0) % 3] AS domain,
  coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
l AS (SELECT {leaf}, CAST(sum(n_tokens) AS HUGEINT) AS tokens, CAST(sum(n_tokens) AS HUGEINT) * {EPOCHS} AS cap FROM s GROUP BY ALL),
d0 AS (SELECT domain, sum(cap) AS cap, {case("domain", DOMAIN_WEIGHTS)} AS w, (SELECT sum(tokens) * {SHARE} // 1000 FROM l) AS budget FROM l GROUP BY domain),
d1 AS {level_sql("d0", "", "domain")},
g0 AS (SELECT domain, lang, sum(cap) AS cap, {case("lang", LANG_WEIGHTS)} AS w, any_value(d1.budget) AS budget FROM l JOIN d1 USING (domain) GROUP BY domain, lang),
g1 AS {level_sql("g0", "domain", "lang")},
t0 AS (SELECT {leaf}, sum(cap) AS cap, {DEFAULT_WEIGHT} AS w, any_value(g1.budget) AS budget FROM l JOIN g1 USING (domain, lang) GROUP BY {leaf}),
t1 AS {level_sql("t0", "domain, lang", "source")},
e AS (SELECT {leaf}, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS part FROM l JOIN t1 USING ({leaf})),
k AS (SELECT s.*, whole, part, md5('{SEED}:' || CAST(whole AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM s JOIN e USING ({leaf}))
SELECT doc_id, {leaf}, n_tokens, CAST(whole + CASE WHEN part > 0 AND sum(n_tokens) OVER (PARTITION BY {leaf} ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= part THEN 1 ELSE 0 END AS BIGINT) AS n_copies FROM k
"""
