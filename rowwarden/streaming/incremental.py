"""The same checks as files arrive: a stream of rows is checked micro-batch by micro-batch, and state is kept in tables.

Each batch is written under its number, so a batch that runs twice after a failure replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import conformance


def check_stream(cells: DataFrame, contract: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Writes totals and errors of each batch of a stream of cells under path/totals and path/errors."""

    def batch(rows: DataFrame, number: int) -> None:
        checked = conformance.check(rows, contract)
        checked.totals.write.mode("overwrite").parquet(f"{path}/totals/batch={number}")
        checked.errors.write.mode("overwrite").parquet(f"{path}/errors/batch={number}")

    out = cells.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def totals_so_far(batches: DataFrame) -> DataFrame:
    """Rows, ragged rows and cells of each resource over all batches."""
    return batches.groupBy("resource_id").agg(*[F.sum(c).alias(c) for c in ("rows", "ragged_rows", "cells_checked")])


def errors_so_far(batches: DataFrame, keep: int = conformance.ROWS_KEPT) -> DataFrame:
    """Failures of each field over all batches, with the first row numbers; each batch has at most `keep` of those."""
    rows = F.slice(F.array_sort(F.flatten(F.collect_list("first_rows"))), 1, keep)
    return batches.groupBy("resource_id", "field", "kind").agg(F.sum("errors").alias("errors"), rows.alias("first_rows"))


def failures_per_window(events: DataFrame, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """Failures (ts, host) by host and window of time, with a watermark for late ones."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes"), "host").agg(F.count("*").alias("failures"))
