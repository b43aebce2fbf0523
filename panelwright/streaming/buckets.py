"""Turn an event stream into a panel: watermarked sums per series and time bucket.

State is one row per (series, open bucket); the watermark closes buckets, so it doesn't grow with the stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.frame import ArgumentError, check_known, cols, quote
from panelwright.operators.panel import frequency_to_step, panel

#: Frequencies whose steps are fixed lengths of time, which is what a window needs.
FIXED = ("second", "minute", "halfhour", "hour", "day", "week", "biweekly")


def bucket(events: DataFrame, *, time: str, value: str, keys: tuple[str, ...], frequency: str, delay: str) -> DataFrame:
    """(keys, date, value, n): sums and counts per bucket; events later than ``delay`` are left out."""
    if frequency not in FIXED:
        raise ArgumentError(f"a bucket is one of {', '.join(FIXED)}")
    check_known(events, [time, value, *keys])
    stamped = events.withColumn("_at", F.col(quote(time)).cast("timestamp")).withWatermark("_at", delay)
    window = F.window("_at", frequency_to_step(frequency))
    sums = stamped.groupBy(window.alias("_w"), *cols(keys)).agg(F.sum(F.col(quote(value))).alias(value), F.count(F.lit(1)).alias("n"))
    return sums.select(*cols(keys), F.col("_w.start").alias("date"), F.col(quote(value)), "n")


def forecast_batches(buckets: str, keys: tuple[str, ...], value: str, frequency: str, run: Callable) -> Callable:
    """A ``foreachBatch`` function: append closed buckets to the table at ``buckets``, then hand the panel to ``run``."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(buckets)
        # a batch that is retried is written twice: the row of the last batch counts
        table = spark.read.parquet(buckets).groupBy(*cols(keys), "date").agg(F.max_by(F.col(quote(value)), "batch").alias(value))
        run(panel(table, groups=keys, date="date", frequency=frequency, target=value, fill_time=True, target_na="zero"), number)

    return each
