import os
import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from quern.operators import accept
from quern.streaming import accept as stream_accept
from quern.streaming import state


#: A time after the first watermark, which is zero.
START = 1_700_000_000_000


def in_batches(spark, rows, schema, tmp_path):
    """A stream of one file a batch, in the order of rows (a stream takes files by their times of modification)."""
    at = tmp_path / f"in-{uuid.uuid4().hex}"
    for i, part in enumerate(rows):
        old = set(at.glob("*.parquet"))
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(at))
        for file in set(at.glob("*.parquet")) - old:
            os.utime(file, (1_700_000_000 + 10 * i,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(at))


def cut(rows, n):
    size = -(-len(rows) // n)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


@pytest.mark.parametrize("flags", [{}, {"best_only": True, "threshold": 7}])
def test_acceptance_over_batches_equals_the_batch_rule(spark, tmp_path, flags):
    rnd = random.Random(1)
    rows = [(rnd.choice([1, 1, 1, 2, None]), i, s := rnd.choice([None, *range(9)]), rnd.choice([None, f"h{s}", f"g{s}"])) for i in range(200)]
    parts = cut(rows, 5)
    for p in parts:
        rnd.shuffle(p)
    schema = "job long, seq long, score long, hash string"
    found = stream_accept.run_available(stream_accept.accepted_stream(in_batches(spark, parts, schema, tmp_path), 8, **flags), str(tmp_path))
    key = lambda r: (r.job is None, r.job, r.seq)
    want = accept.accepted(spark.createDataFrame(rows, schema), 8, **flags).select("job", "seq", "score", "hash", "best_before").collect()
    assert sorted(map(tuple, sorted(found.collect(), key=key)), key=str) == sorted(map(tuple, want), key=str)


def test_jobs_go_when_asked_and_done(spark, tmp_path):
    rnd = random.Random(3)
    rows, out = [], {}
    for i in range(160):
        job = rnd.randint(1, 3)
        step = rnd.choice([1, -1, 0]) if out.get(job, 0) else rnd.choice([1, 0])
        out[job] = out.get(job, 0) + step
        rows.append((job, i, step or None, rnd.choice([False, None, None, True]) if not step else None))
    want, open_, asked = [], {}, set()
    for job, i, step, ask in rows:
        open_[job] = open_.get(job, 0) + (step or 0)
        if ask:
            asked.add(job)
        if job in asked and not open_[job] and (ask or (step or 0) < 0):
            want.append((job, i))
            asked.discard(job)
    assert len(want) > 10
    found = state.removals(in_batches(spark, cut(rows, 6), "job long, seq long, step int, ask boolean", tmp_path))
    assert sorted(map(tuple, stream_accept.run_available(found, str(tmp_path)).collect())) == sorted(want)


def test_a_removed_job_leaves_no_state(spark, tmp_path):
    rows = [[(1, 1, 1, False), (2, 1, 1, False)], [(1, 2, 0, True), (1, 3, -1, False)]]
    stream = state.removals(in_batches(spark, rows, "job long, seq long, step int, ask boolean", tmp_path))
    query = stream.writeStream.format("memory").queryName("gone").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r) for r in spark.table("gone").collect()] == [(1, 3)]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1  # job 2 alone


def test_silence_by_event_time(spark, tmp_path):
    """User 1 goes silent, user 2 comes late, first within the second half period, user 3 stays, user 4 has a gap inside a batch."""
    at = lambda u, s: (u, s)
    parts = [[at(1, 0), at(2, 0), at(3, 0)], [at(3, 100)], [at(2, 115), at(3, 150), at(4, 116), at(4, 250)], [at(2, 251), at(3, 252), at(None, 253)], [at(3, 300), at(2, 310)]]
    parts = [[(u, START + s * 1000) for u, s in p] for p in parts]
    stream = in_batches(spark, parts, "u long, ms long", tmp_path).withColumn("t", F.timestamp_millis("ms"))
    found = stream_accept.run_available(state.silences(stream, "u", "t", 100_000, 20_000), str(tmp_path)).collect()
    found = sorted((u, (last - START) // 1000, (silent - START) // 1000) for u, last, silent in map(tuple, found))
    assert found == [(1, 0, 120), (2, 115, 235), (4, 116, 236)]


def test_silence_by_the_clock_gives_one_grace_period(spark, tmp_path):
    stream = in_batches(spark, [[(1, None, "x"), (2, None, "x")]], "u long, ms long, t0 string", tmp_path).withColumn("t", F.current_timestamp())
    query = state.silences(stream, "u", "t", 2000, 2000, event_time=False).writeStream.format("memory").queryName("quiet").option("checkpointLocation", str(tmp_path / "c2")).trigger(processingTime="200 milliseconds").start()
    try:
        began = time.time()
        while time.time() - began < 60 and spark.table("quiet").count() < 2:
            time.sleep(0.3)
        rows = spark.table("quiet").collect()
        assert sorted(r.user_id for r in rows) == [1, 2] and all(r.silent - r.last == 4000 for r in rows)
    finally:
        query.stop()


def test_results_of_work_over_batches(spark, tmp_path):
    """Results in time, before their work, after its time, and of no known work; nothing is joined twice."""
    t = lambda *rows: [(k, START + h * 3_600_000) for k, h in rows]
    work = [t((1, 0), (2, 0)), t((3, 5)), t((4, 9))]
    done = [t((1, 1), (1, 2), (9, 1)), t((2, 3), (3, 4), (3, 6)), t((4, 9), (1, 10))]
    w = in_batches(spark, work, "work long, ms long", tmp_path).select("work", F.timestamp_millis("ms").alias("given"))
    d = in_batches(spark, done, "work long, ms long", tmp_path).select("work", F.timestamp_millis("ms").alias("done"))
    found = stream_accept.run_available(state.results_of_work(w, d, "2 hours", "3 hours"), str(tmp_path))
    assert sorted((r.work, int(r.done.timestamp() - START // 1000) // 3600) for r in found.collect()) == [(1, 1), (1, 2), (3, 6), (4, 9)]
