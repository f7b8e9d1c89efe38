"""Lookups as joins: exact ones take the first match, approximate ones the nearest row by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafcalc.functions.values import NA


def first_match(table: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, keys compared without case."""
    k = F.upper(F.col(key)) if dict(table.dtypes)[key] == "string" else F.col(key)
    by = Window.partitionBy("__key").orderBy(order)
    return table.withColumn("__key", k).withColumn("__n", F.row_number().over(by)).filter("__n = 1").drop("__n")


def vlookup(left: DataFrame, key: Column, table: DataFrame, table_key: str, result: str, order: str, name: str) -> DataFrame:
    """left with the result of the first equal key, and #N/A in name_error where there is none."""
    right = first_match(table, table_key, order).select("__key", F.col(result).alias(name), F.lit(True).alias("__hit"))
    out = left.withColumn("__key", key).join(right, "__key", "left")
    return out.withColumn(f"{name}_error", F.when(F.col("__hit").isNull(), NA)).drop("__key", "__hit")


def nearest(left: DataFrame, key: str, table: DataFrame, table_key: str, result: str, name: str, larger: bool = False, ranges: int = 64) -> DataFrame:
    """left with the result of the largest table key that is not larger than its own (or the smallest not smaller).

    Both sides are sorted together and the last table row is carried forward, so no row of one side is paired
    with many of the other. Ranges of keys, cut at quantiles, run in parallel; what a range begins with comes
    from one row per range before it.
    """
    sign = -1.0 if larger else 1.0
    cuts = sorted(set(table.select((F.col(table_key).cast("double") * sign).alias("k")).approxQuantile("k", [i / ranges for i in range(1, ranges)], 0.005)))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>"), lambda c: c <= F.col("__k")))
    kind = table.schema[result].dataType
    rows = left.select((F.col(key).cast("double") * sign).alias("__k"), F.lit(1).alias("__side"), F.lit(None).cast(kind).alias("__r"), F.struct(*left.columns).alias("__row"))
    keys = table.select((F.col(table_key).cast("double") * sign).alias("__k"), F.lit(0).alias("__side"), F.col(result).alias("__r"), F.lit(None).cast(rows.schema["__row"].dataType).alias("__row")).filter("__k IS NOT NULL")
    ends = keys.withColumn("__part", part).groupBy("__part").agg(F.max_by(F.struct("__r"), "__k").alias("__end"))
    shape = left.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("__part"))
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = shape.join(ends, "__part", "left").withColumn("__before", F.last("__end", ignorenulls=True).over(before)).select("__part", "__before")
    run = Window.partitionBy("__part").orderBy("__k", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.unionByName(keys).withColumn("__part", part)
    both = both.withColumn("__hit", F.last(F.when(F.col("__side") == 0, F.struct("__r")), ignorenulls=True).over(run)).filter("__side = 1")
    out = both.join(F.broadcast(carried), "__part")  # one row for each range
    return out.select("__row.*", F.when(F.col("__k").isNotNull(), F.coalesce("__hit", "__before")["__r"]).alias(name))
