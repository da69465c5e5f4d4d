"""Delivered lines and contacts as streams.

Validation keeps no state, so a stream of lines is split like a table. Daily totals of contacts are a windowed aggregate with a watermark, as rows may come weeks late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bintangle.operators.parse_rows import classify


def split_lines(lines: DataFrame, valid_path: str, reject_path: str, checkpoint: str) -> StreamingQuery:
    """Write the valid rows of a stream of lines to one table, by file kind, and the unusable lines with their reasons to another. Batches that are tried again overwrite themselves."""

    def write(batch: DataFrame, number: int) -> None:
        checked = classify(batch).persist()
        try:
            rows = checked.where(F.col("reason").isNull() & ~F.col("is_comment")).drop("reason", "is_comment")
            rows.write.mode("overwrite").partitionBy("file_kind").parquet(f"{valid_path}/batch={number}")
            checked.where("reason IS NOT NULL").select(*lines.columns, "reason").write.mode("overwrite").parquet(f"{reject_path}/batch={number}")
        finally:
            checked.unpersist()

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_totals(contacts: DataFrame, late: str = "30 days") -> DataFrame:
    """Streaming aggregate in update mode: per map and day of loading, contacts and the sum of their positive values; rows later than ``late`` are dropped by the watermark."""
    usable = F.when((F.col("v") > 0) & ~F.isnan("v"), F.col("v"))
    return contacts.withWatermark("loaded_at", late).groupBy("map_id", F.window("loaded_at", "1 day").alias("day")).agg(F.count("*").alias("n"), F.sum(usable).alias("total"))
