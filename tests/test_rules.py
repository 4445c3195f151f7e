import random

import pytest
from pyspark.sql import functions as F

from quern.functions import listing
from quern.operators import ordered, scoring, tables


def test_small_data_needs_the_relocation_behind_it(spark):
    rows = [("lis", "r3,5"), ("R_PPC_EMB_SDA21", "d"), ("lwz", "r4,0(r13)"), ("li", "r3,7"), ("R_PPC_REL24", "f"), ("addi", "r3,r2,8"), ("R_PPC_EMB_SDA21", "e"), ("lwz", "r4,4(r2)"), ("R_PPC_EMB_SDA21", "e"), ("li", "r9,1")]
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "k long, n long, op string, args string")
    got = [(r.op, r.args) for r in ordered.small_data_rows(df, "k", "n", "op", "args", "op").orderBy("n").collect()]
    want = list(rows)
    want[0], want[5], want[7] = ("addis", "r3,0,5"), ("addi", "r3,0,8"), ("lwz", "r4,4(0)")
    assert got == want


def test_very_large_addends_go(spark):
    cases = [("lwz\tr3,0(r4)", "R_PPC_ADDR16\tx+0x7fffff00", "lwz\tr3,x(r4)"), ("lwz\tr3,0(r4)", "R_PPC_ADDR16\tx+0x70000000", "lwz\tr3,x+0x70000000(r4)"), ("lwz\tr3,0(r4)", "R_PPC_ADDR16_LO\tx+0x7fffff00", "lwz\tr3,x+0x7fffff00@l(r4)"), ("lwz\tr3,0(r4)", "R_PPC_ADDR16\tx+0x10", "lwz\tr3,x+0x10(r4)")]
    df = spark.createDataFrame(cases, "line string, note string, want string")
    assert [r.got for r in df.select(listing.relocated(df.line, df.note, "ppc").alias("got")).collect()] == [c[2] for c in cases]


def regions_of(spark, marks):
    """One key a text of s (start), e (end) and other letters."""
    return spark.createDataFrame([(k, i, c) for k, text in marks.items() for i, c in enumerate(text)], "k long, n long, c string")


def test_regions(spark):
    df = regions_of(spark, {1: "asbcesde", 2: "abc", 3: "se", 4: "sxe"})
    starts, ends = F.col("c") == "s", F.col("c") == "e"
    assert sorted((r.k, r.first, r.last) for r in ordered.regions(df, "k", "n", starts, ends).where("first is not null").collect()) == [(1, 2, 3), (1, 6, 6), (4, 1, 1)]
    chosen = {}
    for r in ordered.chosen_region(df, "k", "n", starts, ends, "x").collect():
        chosen.setdefault(r.k, []).append(r.c)
    assert "".join(sorted(chosen[1])) in ("bc", "d") and sorted(chosen[2]) == ["a", "b", "c"] and 3 not in chosen and chosen[4] == ["x"]
    for bad in ("sase", "ae", "sa", "es"):
        with pytest.raises(Exception, match="don't match"):
            ordered.regions(regions_of(spark, {1: bad}), "k", "n", starts, ends).collect()


def test_error_counts(spark):
    df = spark.createDataFrame([(1, 5, False), (1, 10**9, None), (1, None, True), (1, 0, True), (2, None, None)], "job long, score long, internal boolean")
    assert {tuple(r) for r in scoring.error_counts(df, "job", F.col("internal")).collect()} == {(1, 4, 3, 2, 5), (2, 1, 0, 0, None)}


def test_fair_service_equals_a_server(spark):
    rnd = random.Random(5)
    jobs = {j: (rnd.randint(1, 5), [rnd.randint(0, 9) for _ in range(rnd.randint(1, 40))]) for j in "abcd"}
    rows = [(j, i, d, p) for j, (p, ds) in jobs.items() for i, d in enumerate(ds)]
    spent, at, want = dict.fromkeys(jobs, 0), dict.fromkeys(jobs, 0), []
    while open_ := [j for j in jobs if at[j] < len(jobs[j][1])]:
        j = min(open_, key=lambda j: (spent[j] * 60 // jobs[j][0], j))
        want.append((j, at[j]))
        spent[j] += jobs[j][1][at[j]]
        at[j] += 1
    df = spark.createDataFrame(rows, "job string, unit long, duration long, priority int")
    assert [(r.job, r.unit) for r in tables.fair_service(df, 60).orderBy("position").collect()] == want
    assert tables.fair_service(df, 60, least_priority=6).count() == 0


def test_overlays_and_chains_with_repeated_keys(spark):
    base, layer = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "name string, weight double"), spark.createDataFrame([("b", 5.0), ("b", 7.0), (None, 1.0), ("a", None)], "name string, weight double")
    assert sorted(map(tuple, tables.overlay(base, layer).collect())) == [("a", 1.0), ("b", 7.0)]
    links = spark.createDataFrame([(3, 2), (3, 1), (2, 0), (None, 1), (4, None)], "node long, up long")
    assert sorted(map(tuple, tables.chain_ends(links).collect())) == [(2, 0), (3, 1)]
    with pytest.raises(ValueError):
        tables.wildcard_edges(spark.range(tables.MOST_TOKENS + 1).selectExpr("concat(id, '*') as token"), spark.createDataFrame([("a",)], "name string"))


def test_fair_order_over_parts_with_ties_and_nulls(spark):
    """Many jobs share each energy, so ties reach over parts."""
    priorities = {k: None if k == 7 else k % 3 + 1 for k in range(40)}
    jobs = spark.createDataFrame(list(priorities.items()), "job long, priority long").withColumn("position", F.lit("own"))
    got = [tuple(r) for r in tables.fair_order(jobs, 25, 60).orderBy("position").collect()]
    units = [(None if p is None else 60 * u // p, job, u) for job, p in priorities.items() for u in range(1, 26)]
    want = sorted(units, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    assert got == [(job, u, energy, n) for n, (energy, job, u) in enumerate(want, 1)]
    assert tables.fair_order(jobs.limit(0), 25, 60).isEmpty()
