"""Whitening of embeddings by hierarchical merging of singular value decompositions.

Each partition of the fit list keeps a count, exact sums of its dimensions, and all singular values and vectors of its
centred rows. Two such summaries merge without loss: their scaled vectors are stacked above one row, the difference of the
means times sqrt(n * m / (n + m)), and decomposed again. Summaries merge in groups, round by round, until one is left. It
holds the covariance of all rows in all dimensions, whatever the number of partitions.

Entries are whole numbers, floor(scale * c); the fit list holds each distinct vector once. Rows whose vector is null, is
empty, or holds a null, a NaN or an infinity are left out, and so are vectors of another length than the most common one (of
equally common lengths the longest). Repeated rows and ids each give their own result; a null id stays null. A component without
variance (fewer distinct vectors than dimensions, or a constant one) has whitened null and is no part of identity_error; a table
of one distinct vector has no explained either. A deviation beyond a long is null. Equal eigenvalues leave their components open within
their span; they are the same for all rows. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafcalc.llm.common import discard, lean, stored

#: Steps of a unit in the whole-number grid, rows decomposed at a time, summaries merged by one task.
SCALE, LEAF_ROWS, FAN_IN = 256, 4096, 8
SUMMARY = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("axes", pa.list_(pa.float64()))])
SUMMARY_DDL = "part long, n long, sums array<decimal(38,0)>, axes array<double>"


@dataclass
class Summary:
    """n rows: their exact sums, and `axes`, whose Gram matrix is that of the centred rows: singular values times vectors."""

    n: int
    sums: list[int]
    axes: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Summary:
        n, sums = len(x), exact_sums(x)
        return Summary(n, sums, decomposed(deviations(x, n, sums).astype(np.float64) / n))

    def merged(self, other: Summary) -> Summary:
        n = self.n + other.n
        # The difference of the means as one fraction of whole numbers, so that close means lose nothing.
        gap = np.array([(a * other.n - b * self.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums, strict=True)], np.float64)
        row = gap * np.sqrt(self.n / n * other.n)
        return Summary(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], decomposed(np.vstack([self.axes, other.axes, row[None, :]])))


def exact_sums(x: np.ndarray) -> list[int]:
    if np.abs(x).max(initial=0) < (1 << 62) // max(1, len(x)) and x.min(initial=0) > -(1 << 63):
        return [int(s) for s in x.sum(0)]
    return [int(s) for s in x.astype(object).sum(0)]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: in 64 bits where they suffice, else in whole numbers of Python."""
    most = max([0, *map(abs, sums)])
    peak = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if peak * n + most < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def decomposed(rows: np.ndarray) -> np.ndarray:
    """Singular values times right vectors, as many as there are dimensions."""
    d = rows.shape[1]
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    out = np.zeros((d, d))
    out[: len(s)] = s[:, None] * vt
    return out


def matrix(column: pa.Array, kind=np.int64) -> np.ndarray:
    """Lists of one length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), kind)


def batch_of(part: int, s: Summary) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"part": part, "n": s.n, "sums": [Decimal(x) for x in s.sums], "axes": s.axes.ravel()}], SUMMARY)


def summaries(t: pa.Table | pa.RecordBatch) -> Iterator[Summary]:
    for n, sums, axes in zip(t.column("n").to_pylist(), t.column("sums").to_pylist(), t.column("axes"), strict=True):
        flat = axes.values.to_numpy(zero_copy_only=False)
        yield Summary(n, [int(x) for x in sums], flat.reshape(-1, len(sums)))


@lean
def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The summary of a partition of the fit list (part, x), a block of rows at a time."""
    total, part = None, 0
    for b in batches:
        for i in range(0, b.num_rows, LEAF_ROWS):
            block = b.slice(i, LEAF_ROWS)
            part = block.column(0)[0].as_py()
            one = Summary.of(matrix(block.column(1)))
            total = one if total is None else total.merged(one)
    if total is not None:
        yield batch_of(part, total)


@lean
def merged_group(t: pa.Table) -> pa.Table:
    t = t.sort_by("part")
    total = None
    for s in summaries(t):
        total = s if total is None else total.merged(s)
    return pa.Table.from_batches([batch_of(t.column("part")[0].as_py() // FAN_IN, total)])


def whole_vectors(vec: str, scale: int) -> Column:
    """The vector in steps of 1 / scale; null where an entry is missing or not finite, or where there is none."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    good = F.col(vec).isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, lambda c: bad(c.cast("double")))
    return F.when(good, F.transform(vec, lambda c: F.floor(c.cast("double") * scale)))


@dataclass
class Whitening:
    """A fitted transform: n, sums, all eigenvalues (falling) and unit eigenvectors (rows) of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def of(s: Summary) -> Whitening:
        _, sv, vt = np.linalg.svd(s.axes, full_matrices=True)
        e = sv * sv / s.n
        floor = max(e[0], 0.0) * len(e) * np.finfo(float).eps if len(e) else 0.0
        return Whitening(s.n, s.sums, np.where(e > floor, e, 0.0), vt)

    def explained(self, component: int) -> float | None:
        trace = float(self.values.sum())
        return float(self.values[component]) / trace if trace else None

    def project(self, df: DataFrame, components: int, keep: str) -> DataFrame:
        """keep, deviation, w (an array of whitened coordinates, null without variance) for each row of df (keep, x)."""
        n, sums = self.n, self.sums
        e, axes = self.values[:components], self.vectors[:components]
        turn = np.divide(axes, np.sqrt(e)[:, None], out=np.zeros_like(axes), where=e[:, None] > 0).T
        known = e > 0

        @lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                d = deviations(matrix(b.column(1)), n, sums)
                w = (d / n).astype(np.float64) @ turn
                square = float(np.abs(d).max()) ** 2 * d.shape[1]
                if square < 2.0**62:
                    dev = pa.array((d * d).sum(1).astype(np.int64), pa.int64())
                else:
                    dev = pa.array([y if (y := sum(int(v) ** 2 for v in row)) < 1 << 63 else None for row in d], pa.int64())
                flat = pa.array(w.ravel(), pa.float64(), mask=np.tile(~known, len(w)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([b.column(0), dev, lists], ["id", "deviation", "w"])

        kind = df.schema[keep].dataType.simpleString()
        return df.select(keep, "x").mapInArrow(run, f"id {kind}, deviation long, w array<double>")


def fit(fit_list: DataFrame) -> Whitening | None:
    """The transform of a table of distinct whole-number vectors x of one length; None for an empty one."""
    level = stored(fit_list.select(F.spark_partition_id().cast("long").alias("part"), "x").mapInArrow(leaves, SUMMARY_DDL))
    # Every round divides the number of partitions that can have left a summary.
    while level.count() > 1:
        up = stored(level.groupBy(F.expr(f"part div {FAN_IN}")).applyInArrow(merged_group, SUMMARY_DDL))
        discard(level)
        level = up
    last = next(summaries(level.toArrow()), None)
    discard(level)
    return Whitening.of(last) if last else None


def whitened(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 4, scale: int = SCALE) -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained and identity_error for each row and leading component."""
    rows = df.select(F.col(id_col).alias("id"), whole_vectors(vec_col, scale).alias("x")).filter("x IS NOT NULL")
    kind = rows.schema["id"].dataType.simpleString()
    ddl = f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return df.sparkSession.createDataFrame([], ddl)
    rows = rows.filter(F.size("x") == common.d)
    fit_list = stored(rows.groupBy("x").count().select("x"))
    model = fit(fit_list)
    k = min(components, common.d)
    # The transform is held against the fit list itself, not against its own eigenvalues.
    known = [i for i in range(k) if model.values[i] > 0]
    error = None
    if known:
        w = model.project(fit_list.withColumn("one", F.lit(1)), k, "one")
        pairs = [(i, j) for i in known for j in known if i <= j]
        got = w.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
        error = max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    discard(fit_list)
    out = model.project(rows, k, "id").select("id", "deviation", F.posexplode("w").alias("i", "whitened"))
    share = F.array(*[F.lit(model.explained(i)).cast("double") for i in range(k)])
    return out.select(F.col("id").alias(id_col), (F.col("i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("i")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
