"""Streams that stop and are replayed: expiry by event time, review counters, uploads."""

from datetime import datetime, timedelta

from vacancia.operators import ingest
from vacancia.streaming import lifecycle

START = datetime(2026, 1, 1)
SIGHTINGS, RUNS = "source_id string, external_id string, at timestamp", "source_id string, finished_at timestamp"


def land(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_postings_expire_as_in_the_batch_sweep(spark, tmp_path):
    day = lambda d: START + timedelta(days=d)
    base = str(tmp_path)
    spark.createDataFrame([], SIGHTINGS).write.parquet(f"{base}/sightings")
    spark.createDataFrame([], RUNS).write.parquet(f"{base}/runs")
    # "good" succeeds every day, "ill" until day 2 only; a is seen daily, b until day 2, c returns on day 9, d comes late, e's source fails
    steps = []
    for d in range(0, 14):
        seen = [("good", "a", day(d))] + ([("good", "b", day(d)), ("ill", "e", day(d))] if d <= 2 else []) + ([("good", "c", day(d))] if d in (0, 9) else [])
        seen += [("good", "d", day(d - 0.5))] if d in (3, 4) else []
        steps.append((seen, [("good", day(d))] + ([("ill", day(d))] if d <= 2 else [])))

    def play(output, restart):
        for i, (seen, ended) in enumerate(steps):
            land(spark, seen, SIGHTINGS, f"{base}/{output}/sightings")
            land(spark, ended, RUNS, f"{base}/{output}/runs")
            stream = lifecycle.expiry_stream(spark.readStream.schema(SIGHTINGS).parquet(f"{base}/{output}/sightings"), spark.readStream.schema(RUNS).parquet(f"{base}/{output}/runs"), "1 hour", salts=2)
            q = stream.writeStream.format("parquet").option("path", f"{base}/{output}/out").option("checkpointLocation", f"{base}/{output}/ck").outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination(120)
            if restart and i == 6:  # a replay of the last batch: its commit is lost
                last = max((tmp_path / output / "ck" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
                last.unlink()
                (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
        return sorted((r["external_id"], r["status"], r["at"].date()) for r in spark.read.parquet(f"{base}/{output}/out").collect())

    whole = play("whole", False)
    assert [s for i, s, _ in whole if i == "c"].count("active") == 2 and ("b", "expired") in {(i, s) for i, s, _ in whole}
    final = {}
    for i, s, at in sorted(whole, key=lambda r: r[2]):
        final[i] = s
    # the batch sweep over the same sightings, at the last watermark
    last = {}
    for seen, _ in steps:
        for s, i, at in seen:
            last[s, i] = max(at, last.get((s, i), at))
    rows = spark.createDataFrame([(s, i, "active", at) for (s, i), at in last.items()], "source_id string, external_id string, status string, last_seen_at timestamp")
    runs = spark.createDataFrame([(s, "succeeded", at) for _, ended in steps for s, at in ended], "source_id string, status string, finished_at timestamp")
    swept = {r["external_id"]: r["status"] for r in ingest.expire(rows, runs, day(13) - timedelta(hours=1)).collect()}
    assert final == swept == {"a": "active", "b": "expired", "c": "expired", "d": "expired", "e": "active"}
    assert play("replayed", True) == whole


def test_review_counters_add_nothing_in_a_replay(spark, tmp_path):
    landing, schema = str(tmp_path / "in"), "kind string, value string, context string, job_id long"
    queue = lifecycle.Versions(spark, str(tmp_path / "queue"), lifecycle.QUEUE)

    def advance():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing)
        lifecycle.review_stream(stream, queue, str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(60)
        return int(max((tmp_path / "ck" / "commits").glob("[0-9]*"), key=lambda p: int(p.name)).name)

    land(spark, [("title", "window cleaner", "x", 1), ("title", "window cleaner", "y", 2), ("technology", "go", "z", 2)], schema, landing)
    advance()
    land(spark, [("title", "window cleaner", "w", 3)], schema, landing)
    last = advance()
    read = lambda: {(r["kind"], r["value"]): (r["occurrences"], r["status"]) for r in queue.before(last + 1).collect()}
    before = read()
    assert before == {("title", "window cleaner"): (3, "pending"), ("technology", "go"): (1, "pending")}
    (tmp_path / "ck" / "commits" / str(last)).unlink()  # the batch ran, and the query died before it was committed
    (tmp_path / "ck" / "commits" / f".{last}.crc").unlink(missing_ok=True)
    assert advance() == last and read() == before


def test_uploads_count_once_over_restarts(spark, tmp_path):
    landing, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), "user_id long, content_hash string, uploaded_at timestamp, name string"

    def advance(replay=False):
        if replay:
            last = max((tmp_path / "ck" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
            last.unlink()
            (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
        stream = spark.readStream.schema(schema).parquet(landing)
        lifecycle.upload_stream(stream, out, str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(60)
        return sorted((r["user_id"], r["content_hash"], r["name"]) for r in spark.read.parquet(out).collect())

    at = lambda h: START + timedelta(hours=h)
    land(spark, [(1, "aa", at(0), "first"), (2, "aa", at(0), "other user"), (1, "bb", at(0), "other file")], schema, landing)
    assert len(advance()) == 3
    land(spark, [(1, "aa", at(0), "again")], schema, landing)
    assert len(advance()) == 3
    land(spark, [(1, "aa", at(90), "long after"), (3, "cc", at(90), "new"), (3, "cc", at(90), "new")], schema, landing)  # beyond the watermark
    kept = advance()
    assert kept == [(1, "aa", "first"), (1, "bb", "other file"), (2, "aa", "other user"), (3, "cc", "new")]
    assert advance(replay=True) == kept
