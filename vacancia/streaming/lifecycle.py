"""Streams with state: expiry of postings by event time, the review queue's counters, uploads that count once.

What a batch writes is kept by its number, so a batch that is replayed after a failure writes the same again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from vacancia.operators import ingest, review
from vacancia.sources import stored

DAY_MS = 86_400_000
#: Groups that a source's postings are dealt out to; a group's postings lie in the state store one by one.
SALTS = 256
EXPIRY = "source_id string, external_id string, status string, at timestamp"
QUEUE = "kind string, value string, example_context string, occurrences long, status string"


class Versions:
    """A small table in versions: each batch writes its own from the one before; the last complete one is read."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def before(self, batch: int) -> DataFrame:
        """What batch number ``batch`` builds on: the version of the batch before it."""
        try:
            return self.spark.read.schema(self.schema).parquet(f"{self.path}/version={batch - 1}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/version={batch}")


def review_stream(sightings: DataFrame, queue: Versions, checkpoint: str) -> DataStreamWriter:
    """sightings: a stream of kind, value, context, job_id. A replayed batch starts from the version before it, so it adds nothing twice."""

    def apply(rows: DataFrame, batch: int) -> None:
        queue.write(review.accumulate(queue.before(batch), rows), batch)

    return sightings.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def upload_stream(uploads: DataFrame, path: str, checkpoint: str, delay: str = "1 hour") -> DataStreamWriter:
    """uploads: a stream of user_id, content_hash, uploaded_at, ...: the first of each (user_id, content_hash) is kept below ``path``.

    Repeats near each other are dropped in the state store; those beyond ``delay`` by what earlier batches wrote.
    """
    key = ["user_id", "content_hash"]

    def apply(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        try:
            earlier = spark.read.option("basePath", path).schema(f"{rows.select(*key)._jdf.schema().toDDL()}, batch long").parquet(f"{path}/batch=*").where(F.col("batch") < batch)
            rows = rows.join(earlier.select(*key), key, "left_anti")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    once = uploads.withWatermark("uploaded_at", delay).dropDuplicatesWithinWatermark(key)
    return once.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


class Expiry(StatefulProcessor):
    """Of one group of postings: when each was seen last, when its source last succeeded, and one timer for the next check."""

    def __init__(self, grace_ms: int):
        self.grace = grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.postings = handle.getMapState("postings", "external_id string", "seen bigint, active boolean")
        self.success = handle.getValueState("success", "at bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        success = self.success.get()[0] if self.success.exists() else None
        for frame in rows:
            ms = frame["at"].astype("datetime64[ms]").astype("int64")
            out = []
            for external_id, at, run in zip(frame["external_id"], ms.tolist(), frame["is_run"], strict=True):
                if run:
                    success = at if success is None else max(success, at)
                    continue
                known = self.postings.getValue((external_id,)) if self.postings.containsKey((external_id,)) else None
                if known is None or not known[1]:
                    out.append((key[0], external_id, "active", at))
                self.postings.updateValue((external_id,), (at if known is None else max(at, known[0]), True))
            yield self._rows(out)
        if success is not None:
            self.success.update((success,))
        if not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + 1)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        success = self.success.get()[0] if self.success.exists() else None
        healthy, due, soonest = success is not None and success >= now - self.grace, [], None
        for (external_id,), (seen, active) in self.postings.iterator():
            if active and healthy and seen < now - self.grace:
                due.append((external_id, seen))
            elif active:
                soonest = seen if soonest is None else min(soonest, seen)
        for external_id, seen in due:
            self.postings.updateValue((external_id,), (seen, False))
        if soonest is not None:  # at the next that may fall due, or a day on where a source's failure holds some back
            self.handle.registerTimer(max(soonest + self.grace + 1, now + 1 if soonest + self.grace >= now else now + DAY_MS))
        yield self._rows([(key[0], external_id, "expired", now) for external_id, _ in due])

    @staticmethod
    def _rows(out: list[tuple]) -> pd.DataFrame:
        texts = {name: pd.Series([r[i] for r in out], dtype=object) for i, name in enumerate(("source_id", "external_id", "status"))}
        return pd.DataFrame(texts | {"at": pd.to_datetime([r[3] for r in out], unit="ms")})

    def close(self) -> None:
        pass


def expiry_stream(sightings: DataFrame, runs: DataFrame, delay: str = "1 day", grace_days: int = ingest.GRACE_DAYS, salts: int = SALTS) -> DataFrame:
    """source_id, external_id, status, at: each change of a posting's status, in event time.

    sightings: a stream of source_id, external_id, at; runs: a stream of source_id, finished_at of runs that succeeded. A
    posting expires when the watermark is more than the grace period past its last sighting while its source succeeded
    within that period; seen again, it is active again. A source's runs go to all its groups, its postings to one each.
    """
    spark = sightings.sparkSession
    stored.ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    salt = F.pmod(F.xxhash64("external_id"), F.lit(salts)).cast("int")
    seen = sightings.select("source_id", salt.alias("salt"), "external_id", "at", F.lit(False).alias("is_run"))
    ended = runs.select("source_id", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(None).cast("string").alias("external_id"), F.col("finished_at").alias("at"), F.lit(True).alias("is_run"))
    rows = seen.unionByName(ended).withWatermark("at", delay)
    return rows.groupBy("source_id", "salt").transformWithStateInPandas(Expiry(grace_days * DAY_MS), EXPIRY, "Append", "EventTime")
