import random

import pytest
from pyspark.sql import functions as F

from quern.operators import accept, ordered, ranges, tables


@pytest.fixture(scope="module")
def events(spark):
    """One key has nine rows of ten, among them a null key; values with nulls; columns with the results' names."""
    rnd = random.Random(6)
    rows = [(rnd.choice([7] * 18 + [1, None]), i, rnd.choice([None, "a", "b", "b"]), rnd.randint(0, 5)) for i in range(900)]
    return spark.createDataFrame([(*r, "x") for r in rows], "k long, n long, v string, w long, turn string").repartition(5), rows


def by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_a_hot_key_is_no_single_task(spark, events):
    df, rows = events
    r = ranges.Ranges(df, "k", ["n"])
    sizes = [x["count"] for x in r.rows.groupBy("_r_part", "_r_key").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 0.5 * len(rows)
    r.carry(x=(F.count("*"), F.sum))
    assert r.rows.where("x is not null").select("_r_part", "_r_key").distinct().count() <= 4


def test_lookups(events):
    df, rows = events
    for forward in (False, True):
        for own in (False, True):
            got = {r.n: r.x for r in ordered.as_of(df, "k", "n", F.col("v"), "x", forward, own).collect()}
            for group in by_key(rows).values():
                for i, r in enumerate(group):
                    near = group[i + (not own) :] if forward else group[: i + own][::-1]
                    assert got[r[1]] == next((x[2] for x in near if x[2] is not None), None)
    before = {r.n: r.x for r in ordered.neighbour(df, "k", "n", F.col("v"), "x").collect()}
    for group in by_key(rows).values():
        assert [before[r[1]] for r in group] == [None, *(r[2] for r in group[:-1])]


def test_runs_pairs_and_tails(events):
    df, rows = events
    want_runs, want_pairs, want_kept = [], [], []
    for k, group in by_key(rows).items():
        start = 0
        for i in range(1, len(group) + 1):
            if i == len(group) or group[i][2] != group[start][2]:
                if i - start >= 2:
                    want_runs.append((k, group[start][2], group[start][1], i - start))
                start = i
        want_pairs += [(k, a[1], b[1]) for i, a in enumerate(group) for b in group[i + 1 : i + 5] if a[2] == b[2] and a[2]]
        solid = max((i for i, r in enumerate(group) if r[2] != "b"), default=-1)
        want_kept += [r[1] for r in group[: solid + 1]]
    assert sorted(map(tuple, ordered.runs(df, "k", "n", "v", 2).select("k", "v", "first", "length").collect()), key=str) == sorted(want_runs, key=str)
    assert sorted(map(tuple, ordered.pairs_within(df, "k", "n", "v", 4).collect()), key=str) == sorted(want_pairs, key=str)
    assert sorted(r.n for r in ordered.without_tail(df, "k", "n", F.col("v") == "b").collect()) == sorted(want_kept)


def test_round_robin_and_sums(spark, events):
    df, rows = events
    found = {r.n: (r.turn, r.position) for r in ordered.round_robin(df, "k", "n").collect()}
    turn = {r[1]: i for group in by_key(rows).values() for i, r in enumerate(group, 1)}
    order = sorted(rows, key=lambda r: (turn[r[1]], r[0] is not None, r[0] or 0))
    assert found == {r[1]: (turn[r[1]], i) for i, r in enumerate(order, 1)}
    total = sum(r[3] for r in rows)
    picks = spark.createDataFrame([(i, u) for i, u in enumerate([0, 1, total // 2, total - 1, total])], "pick long, u long")
    got = {r.pick: r.n for r in ordered.weighted_picks(df, "n", "w", picks).collect()}
    sums, want = 0, {}
    for r in rows:
        for i, u in enumerate([0, 1, total // 2, total - 1]):
            if sums <= u < sums + r[3]:
                want[i] = r[1]
        sums += r[3]
    assert got == want


def test_acceptance_of_a_hot_job_with_odd_columns(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([1, 1, 1, 1, None]), i, s := rnd.choice([None, 0, *range(9)]), rnd.choice([None, f"h{s}", f"g{s}"])) for i in range(600)]
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], "job long, seq long, score long, hash string, nth int, best_before int")
    want = []
    for job in (1, None):
        best, seen = 8, set()
        for _, seq, score, h in (r for r in rows if r[0] == job):
            if score is None or h is None or score > 8:
                continue
            if (score == 0 or h not in seen) and score <= best:
                want.append((seq, best, 5))
            best = min(best, score)
            seen.add(h)
    assert sorted((r.seq, r.best_before, r.nth) for r in accept.accepted(df, 8, best_only=True).collect()) == sorted(want)
    assert accept.accepted(df.limit(0), 8).collect() == []


def test_demand_and_empty_tables(spark, events):
    df, rows = events
    got = {r.n: r.units for r in tables.demand(df, "k", "n", F.col("w")).collect()}
    for group in by_key(rows).values():
        total = 0
        for r in group:
            assert got[r[1]] == (total + r[3]) // 2 - total // 2
            total += r[3]
    empty = df.limit(0)
    assert ordered.round_robin(empty, "k", "n").collect() == ordered.runs(empty, "k", "n", "v", 1).collect() == ordered.pairs_within(empty, "k", "n", "v", 2).collect() == []
