"""Incremental cleaning of arriving files: stateless rules, appended a micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cleaned_stream(spark: SparkSession, path: str, schema: str, reason: Column) -> DataFrame:
    """JSON files as they arrive, with the reason of the cleaning rules."""
    return spark.readStream.schema(schema).json(path).withColumn("reason", reason)


def run_available(stream: DataFrame, output: str, checkpoint: str) -> None:
    """Write accepted rows and per-reason counts of all files at hand, once each; safe to repeat."""

    def batch(df: DataFrame, number: int) -> None:
        df.where("reason = 'accepted'").write.mode("overwrite").parquet(f"{output}/accepted/batch={number}")
        df.groupBy("reason").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{output}/reasons/batch={number}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
