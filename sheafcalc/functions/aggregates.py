"""Aggregates, criteria and conditional aggregates of worksheet functions over columns of a table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafcalc.functions.values import DIV0, NUM, Checked


def exact_sum(x: Column) -> Column:
    """A sum that does not depend on the order of rows: cents and ten-thousandths are added as decimals."""
    return F.sum(x.cast("decimal(28,6)")).cast("double")


def sum_(x: Column) -> Column:
    return F.coalesce(exact_sum(x), F.lit(0.0))


def average(x: Column) -> Checked:
    return Checked.of(F.try_divide(exact_sum(x), F.count(x)), (F.count(x) == 0, DIV0))


def min_(x: Column) -> Column:
    return F.coalesce(F.min(x), F.lit(0.0))


def max_(x: Column) -> Column:
    return F.coalesce(F.max(x), F.lit(0.0))


def count(x: Column) -> Column:
    return F.count(x)


def counta(x: Column) -> Column:
    return F.count(x)


def countblank(x: Column) -> Column:
    return F.count_if(x.isNull())


def product(x: Column) -> Column:
    return F.coalesce(F.product(x), F.lit(1.0))


def median(x: Column) -> Checked:
    return Checked.of(F.median(x), (F.count(x) == 0, NUM))


def stdev(x: Column) -> Checked:
    return Checked.of(F.stddev_samp(x), (F.count(x) < 2, DIV0))


def sumproduct(*xs: Column) -> Column:
    out = F.coalesce(xs[0].cast("double"), F.lit(0.0))
    for x in xs[1:]:
        out = out * F.coalesce(x.cast("double"), F.lit(0.0))
    return sum_(out)


def npv(rate: float, x: Column, period: Column) -> Column:
    return F.sum(x / F.pow(F.lit(1.0 + rate), period))


def kth(df: DataFrame, keys: list[str], x: str, k: int, largest: bool = True) -> DataFrame:
    """The k-th largest (or smallest) value of each group; groups with fewer values are #NUM!."""
    by = Window.partitionBy(*keys).orderBy(F.col(x).desc() if largest else F.col(x).asc())
    ranked = df.filter(F.col(x).isNotNull()).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    out = ranked.groupBy(*keys).agg(F.max(F.when(F.col("rank") == k, F.col(x))).alias("value"))
    return out.withColumn("error", F.when(F.col("value").isNull(), NUM))


OPERATORS = re.compile(r"^(<=|>=|<>|=|<|>)?(.*)$", re.S)


def matches(x: Column, criterion, is_text: bool) -> Column:
    """Criterion of the conditional aggregates as a condition: a number, or text such as ">=10", "<>R", "no*th?".

    Blank cells match only "" (equal to blank). A number on the right compares numbers only; text compares
    without case; * and ? stand for any characters in = and <>.
    """
    if isinstance(criterion, (int, float)) and not isinstance(criterion, bool):
        return F.lit(False) if is_text else F.coalesce(x == float(criterion), F.lit(False))
    op, right = OPERATORS.match(str(criterion)).groups()
    op = op or "="
    if right == "":
        return x.isNull() if op == "=" else x.isNotNull() if op == "<>" else F.lit(False)
    try:
        number = float(right)
    except ValueError:
        number = None
    ops = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    if number is not None and not is_text:
        hit = ops[op](x, F.lit(number))
        return F.coalesce(hit, F.lit(op == "<>"))
    if number is not None and op not in ("=", "<>"):
        return F.lit(False)
    if is_text and op in ("=", "<>"):
        if "*" in right or "?" in right:
            pattern = "(?is)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in right) + "$"
            hit = x.rlike(pattern)
        else:
            hit = F.upper(x) == right.upper()
        return F.coalesce(hit if op == "=" else ~hit, F.lit(op == "<>"))
    if is_text:
        return F.coalesce(ops[op](F.upper(x), F.lit(right.upper())), F.lit(False))
    return F.lit(op == "<>")


def countif(when: Column) -> Column:
    return F.count_if(when)


def sumif(when: Column, x: Column) -> Column:
    return sum_(F.when(when, x))


def averageif(when: Column, x: Column) -> Checked:
    return average(F.when(when, x))


def maxifs(when: Column, x: Column) -> Column:
    return max_(F.when(when, x))


def minifs(when: Column, x: Column) -> Column:
    return min_(F.when(when, x))
