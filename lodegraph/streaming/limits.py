"""Rate limits as one-minute windows, over tables and over streams.

Defined results. A call counts in the minute it is made in. With ``rpm`` calls allowed, those beyond
are over the limit. For tokens the first call of a minute is admitted unchecked, later ones as long
as the minute's sum stays within ``tpm``. Rows with a null time are ignored; of calls made at the same
time the one with the lower id comes first. A stream forgets a minute once the watermark has passed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def calls_per_minute(events: DataFrame, rpm: int = 1, time: str = "ts") -> DataFrame:
    """(minute, calls, over): works on tables and, with a watermark, on streams."""
    rows = events.where(F.col(time).isNotNull()).groupBy(F.window(time, "1 minute").alias("w")).agg(F.count("*").alias("calls"))
    return rows.select(F.col("w.start").alias("minute"), "calls", F.greatest(F.lit(0), F.col("calls") - rpm).alias("over"))


def admitted(events: DataFrame, tokens: str, tpm: int, time: str = "ts", key: str = "event_id") -> DataFrame:
    """(key, minute, admitted): token-limited calls, in order of time."""
    w = Window.partitionBy("minute").orderBy(time, key)
    rows = events.where(F.col(time).isNotNull()).withColumn("minute", F.date_trunc("minute", time))
    rows = rows.withColumn("before", F.coalesce(F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.row_number().over(w))
    return rows.select(key, "minute", ((F.col("n") == 1) | (F.col("before") + F.col(tokens) <= tpm)).alias("admitted"))


def stream_calls(spark: SparkSession, folder: str, schema, rpm: int = 1, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The same windows over a folder of parquet files that grows."""
    events = spark.readStream.schema(schema).parquet(folder).withWatermark(time, late)
    return calls_per_minute(events, rpm, time)
