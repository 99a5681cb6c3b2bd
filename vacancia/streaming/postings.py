"""Postings as a stream of landed files: change detection per micro-batch, daily counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from vacancia.operators import ingest

STATE = "source_id string, external_id string, content_hash string, payload string, status string, extractor_version int, first_seen_at timestamp, last_seen_at timestamp"


class StateTable:
    """The latest state of all postings: each batch writes a new version folder, the last complete one is read.

    Parquet can't be merged in place, and a path that is being read is never overwritten. A batch that is replayed
    after a failure writes its own version again, so the outcome is the same.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def before(self, batch: int) -> DataFrame:
        """The state that batch number ``batch`` builds on."""
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(STATE).parquet(f"{self.path}/version={batch - 1}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], STATE)

    def apply(self, incoming: DataFrame, batch: int) -> None:
        merged = ingest.merge(self.before(batch), incoming)
        merged.select(*[c.split()[0] for c in STATE.split(", ")]).write.mode("overwrite").parquet(f"{self.path}/version={batch}")


def merge_stream(postings: DataFrame, state: StateTable, checkpoint: str) -> DataStreamWriter:
    """postings: a streaming frame of source_id, external_id, content_hash, payload, seen_at."""
    return postings.writeStream.foreachBatch(state.apply).option("checkpointLocation", checkpoint)


def daily(events: DataFrame, delay: str = "2 days") -> DataFrame:
    """day, event_type, n, users (approximate): tumbling days in event time, late rows beyond ``delay`` dropped."""
    day = F.window("ts", "1 day")
    counts = events.withWatermark("ts", delay).groupBy(day, "event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users"))
    return counts.select(F.col("window.start").alias("day"), "event_type", "n", "users")
