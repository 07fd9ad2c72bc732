"""Append-only stage events as a stream: an extension, as the events of a run are otherwise read as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, folder: str, schema: StructType | str, fmt: str = "parquet", per_trigger: int = 64) -> DataFrame:
    """The files that land in a folder, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(per_trigger)).format(fmt).load(folder)


def counts_by_window(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events of each kind in each window; what comes later than the watermark is left out, so state is bounded.

    On a table the same plan counts all rows.
    """
    return (
        events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind)
        .agg(F.count("*").alias("n_events")).select(F.col("w.start").alias("window_start"), kind, "n_events")
    )


def run_once(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Write what is there now as Parquet, and stop; the checkpoint makes a later run go on from there."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(sink).awaitTermination()
