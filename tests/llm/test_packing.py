import random
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import functions as F

from quern.llm import packing
from quern.llm.common import stored, tokenizer_path


def serial(sizes, capacity):
    """Sequences that best fit needs with one piece at a time, longest first."""
    gaps, opened = [], 0
    for s in sorted(sizes, reverse=True):
        at = bisect_left(gaps, s)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        opened += at == len(gaps) and gap == capacity
        insort(gaps, gap - s)
    return len(gaps)


def check(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins)


def test_supersteps_need_as_few_sequences_as_serial_best_fit(spark):
    rnd = random.Random(3)
    for mean, n in ((25, 1200),):
        sizes = [min(64, int(rnd.expovariate(1 / mean)) + 1) for _ in range(n)] + [20] * (n // 2)  # a third are of one length
        df = spark.createDataFrame([(i, 0, s, i * 7 % 11) for i, s in enumerate(sizes)], "key long, piece int, length long, ids_crc32 long")
        found = packing.placed(stored(df), 64).collect()
        assert sorted((r.key, r.length) for r in found) == list(enumerate(sizes))
        assert check(found, 64) <= 1.01 * serial(sizes, 64) + 1
    assert packing.placed(df.where("length > 99"), 64).collect() == []


def test_a_superstep_opens_its_sequences_and_broadcasts_one_table_at_most(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(packing, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df))
    rows = stored(spark.range(400).selectExpr("id as key", "0 as piece", "23 + id % 10 as length", "id as ids_crc32"))
    found = packing.placed(rows, 64).collect()
    assert len(found) == 400 and check(found, 64) == 200  # two pieces a sequence
    sweeps = plans[1:]  # the first table is of ranks
    assert len(sweeps) == 1 and max(p.count("BroadcastExchange") for p in sweeps) <= 1


def test_documents_need_two_sequences_more_than_the_sum_at_most(spark):
    found = packing.op2_best_fit_packing(spark, "/root/testdata/sf0.01").collect()
    assert check(found, 1024) <= -(-sum(r.length for r in found) // 1024) + 2


def test_levels_equal_a_stack():
    rnd = np.random.default_rng(2)
    for _ in range(200):
        slots, wants = rnd.integers(0, 4, 12), rnd.integers(0, 4, 12)
        level, floor = packing.levels(slots, wants)
        stack, used = [], set()
        for size in range(11, -1, -1):
            assert level[size] == len(stack)
            stack += [(size, level[size] + 1 + k) for k in range(slots[size])]
            for _ in range(min(wants[size], len(stack))):
                used.add(stack.pop())
        assert used == {(s, level[s] + 1 + k) for s in range(12) for k in range(slots[s]) if level[s] + 1 + k > floor[s]}


def test_long_runs_of_one_character(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), packing.encoding(path)
    n = 700_000
    for text in (" " * n, "a" + " " * n + "b", "a" + "\n \t\xa0" * (n // 4) + "\x1c", " " * 5000 + "<|endoftext|>" + " " * 5000 + "x  y", "\n" * 4096 + "\u3000" * 4097 + "é"):
        assert packing.token_ids(encoder, text).tolist() == library.encode(text, add_special_tokens=False).ids
    many = spark.createDataFrame([(1, " " * 10_000_000), (None, "x" * 10_000_000), (None, "x")], "doc_id long, text string")
    packed = packing.pack(many, path)
    assert {r.doc_id: r.n for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == {1: 10_000_001, None: 1_250_000 + 3}
