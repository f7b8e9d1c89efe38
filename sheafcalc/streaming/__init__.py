"""Audits of workbooks as they arrive (an extension: nothing else here is a stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheafcalc.operators.rules import audit
from sheafcalc.sources.history import append_run


def audit_stream(spark: SparkSession, cells_path: str, runs_path: str, checkpoint: str):
    """A streaming query over folders of cell tables: each batch of new workbooks is audited and its run appended."""
    from sheafcalc.operators.cells import SCHEMA

    def batch(cells: DataFrame, number: int) -> None:
        append_run(audit(cells), runs_path, f"batch-{number}")

    return spark.readStream.schema(SCHEMA).parquet(cells_path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
