"""The source ledger as a stream: agreement events add to it, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["domain", "category", "field"]


def ledger_stream(seen: DataFrame) -> DataFrame:
    """Running (domain, category, field, alpha, beta) of a stream of (domain, category, field, agree, disagree)."""
    return seen.groupBy(*KEYS).agg((1.0 + F.sum("agree")).alias("alpha"), (1.0 + F.sum("disagree")).alias("beta"))


def run_to_end(spark: SparkSession, seen: DataFrame, folder: str) -> DataFrame:
    """Runs the stream over what is there now; the last state of each key, from a table in ``folder``.

    Each batch appends the keys it changed with the batch's number, so a batch that is run again after a
    failure writes the same rows and the newest row of a key holds.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/ledger/batch={number}")

    query = ledger_stream(seen).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.option("basePath", f"{folder}/ledger").parquet(f"{folder}/ledger/batch=*")
    return rows.groupBy(*KEYS).agg(F.max_by("alpha", "batch").alias("alpha"), F.max_by("beta", "batch").alias("beta"))


def windowed_agreement(seen: DataFrame, at: str, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Agreement by domain and event-time window; events later than ``late`` are dropped by the watermark."""
    return seen.withWatermark(at, late).groupBy(F.window(at, every), "domain").agg(F.sum("agree").alias("agree"), F.sum("disagree").alias("disagree"))
