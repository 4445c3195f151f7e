import os
import random

import pytest
from pyspark.sql import functions as F

from quern.sources import sinks
from tests.test_state import in_batches

SCHEMA = "job long, seq long, score long, source string"


def results(n, start, seed):
    rnd = random.Random(seed)
    return [(rnd.choice([1, 2, None]), start + i, rnd.choice([0, 5, 9]), f"s{start + i}") for i in range(n)]


def plain(rows):
    counts, out = {}, []
    for job, seq, score, source in rows:
        counts[job, score] = counts.get((job, score), 0) + 1
        out.append((job, seq, score, source, counts[job, score], f"output-{score}-{counts[job, score]}"))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r)[:6] for r in df.select("job", "seq", "score", "source", "counter", "name").collect()), key=str)


def test_counters_go_on_over_runs(spark, tmp_path):
    path = str(tmp_path / "out")
    a, b = results(40, 0, 1), results(30, 40, 2)
    assert rows_of(sinks.write_results(spark.createDataFrame(a, SCHEMA), path)) == plain(a)
    assert rows_of(sinks.write_results(spark.createDataFrame(b, SCHEMA), path)) == plain(a + b)
    assert rows_of(sinks.write_results(spark.createDataFrame(b, SCHEMA), path, batch=1)) == plain(a + b)  # again
    with pytest.raises(ValueError):
        sinks.write_results(spark.createDataFrame(a, SCHEMA), path, batch=0)
    assert rows_of(sinks.write_results(spark.createDataFrame([], SCHEMA), path)) == plain(a + b)


def test_a_stream_that_fails_after_a_batch_goes_on_without_gap_or_double(spark, tmp_path, monkeypatch):
    rows = results(90, 0, 3)
    path, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream = in_batches(spark, [rows[:30], rows[30:60], rows[60:]], SCHEMA, tmp_path)
    real, calls = sinks.write_batch, []

    def fails_once(df, at, batch):
        calls.append(batch)
        real(df, at, batch)
        if len(calls) == 2:
            raise OSError("lost after the write")

    monkeypatch.setattr(sinks, "write_batch", fails_once)
    with pytest.raises(Exception, match="lost after the write"):
        sinks.write_stream(stream, path, state).start().awaitTermination()
    sinks.write_stream(stream, path, state).start().awaitTermination()
    assert calls == [0, 1, 1, 2]
    assert rows_of(sinks.batches(spark, path, sinks.RESULT)) == plain(rows)


def test_sources_are_scored_once(spark, tmp_path):
    path, asked = str(tmp_path / "memo"), []

    def score(new):
        asked.append(sorted(r.source for r in new.collect()))
        return new.where("source <> 'bad'").select("digest", F.length("source").alias("score"))

    def run(*sources):
        df = spark.createDataFrame([(i, s, -1) for i, s in enumerate(sources)], "id long, source string, score long")
        return {r.id: r.score for r in sinks.scored_once(df, path, score).collect()}

    assert run("a", "bbb", "a", None, "bad", "") == {0: 1, 1: 3, 2: 1, 3: None, 4: None, 5: 0}
    assert run("bbb", "cc", "bad") == {0: 3, 1: 2, 2: None}
    assert run("a", "cc") == {0: 1, 1: 2}
    assert asked == [["", "a", "bad", "bbb"], ["cc"]]
    assert len([d for d in os.listdir(path) if d.startswith("batch=")]) == 2
