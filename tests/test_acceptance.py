import random

import pytest

from quern import catalog
from quern.functions import variants
from quern.operators import accept


def test_base_hash_and_rows_without_source(spark):
    rows = [(1, 1, 5, "a", "x"), (1, 2, 5, "b", None), (1, 3, 5, "c", "x"), (1, 4, 0, "a", "x"), (1, 5, 0, "d", "x"), (1, 6, 0, "d", "x")]
    df = spark.createDataFrame(rows, "job long, seq long, score long, hash string, source string")
    assert [r.seq for r in accept.accepted(df, 7).orderBy("seq").collect()] == [1, 3, 4, 5, 6]
    assert [r.seq for r in accept.accepted(df, 7, base_hash="a").orderBy("seq").collect()] == [3, 5, 6]


def test_stream_reads_a_table_of_several_files(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, None, rnd.randint(0, 5), rnd.choice(["view", "click"]), float(rnd.randint(0, 250)), "{}") for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    df.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").write.parquet(str(tmp_path / "events.parquet"))
    want = sorted((r.job, r.seq) for r in catalog.QUERIES["accept_best_only"](spark, str(tmp_path)).collect())
    got = sorted((r.job, r.seq) for r in catalog.QUERIES["stream_accept"](spark, str(tmp_path)).collect())
    assert got == want and len(want) > 5


def test_seeds_outside_of_a_space(spark):
    with pytest.raises(ValueError):
        variants.at_seeds(spark, variants.integer(1, 3), [3])
    assert [r.variant for r in variants.at_seeds(spark, variants.integer(1, 3), [2, 0]).collect()] == ["3", "1"]
