import random

import pytest

from quern import catalog
from quern.functions import listing, variants
from quern.operators import accept, ordered, scoring, tables
from quern.sources.tables import elf_machine, job_folders, settings
from tests.compare import assert_equal

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert_equal(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], SF)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plain_accept(rows, base, better_only, best_only, threshold):
    best, seen, out = base, set(), []
    for seq, score, h in rows:
        if score > base or (best_only and score > best) or not (score < base or (score == base and not better_only)):
            keep = False
        else:
            keep = (threshold is None or score < threshold) and h not in seen
        if keep:
            out.append(seq)
            best = min(best, score)
            if score:
                seen.add(h)
    return out


def test_acceptance_equals_the_sequential_rule(spark):
    rnd = random.Random(4)
    for flags in ({}, {"better_only": True}, {"best_only": True}, {"threshold": 4}, {"best_only": True, "better_only": True, "threshold": 6}):
        rows = [(j, i, s := rnd.randint(0, 9), f"h{s}{rnd.randint(0, 2)}") for j in range(40) for i in range(25)]
        df = spark.createDataFrame(rows, "job long, seq long, score long, hash string")
        got = sorted((r.job, r.seq) for r in accept.accepted(df, 7, **flags).collect())
        full = {"better_only": False, "best_only": False, "threshold": None} | flags
        assert got == sorted((j, i) for j in range(40) for i in plain_accept([r[1:] for r in rows if r[0] == j], 7, **full))


def test_enumeration_covers_every_variant_once(spark):
    v = variants
    space = v.combine(v.choice(v.text("a"), v.combine(v.text("b"), v.integer(0, 3))), v.orders([v.text("x"), v.choice(v.text("y"), v.text("z")), v.text("w")], ","), v.integer(-1, 1))
    rows = v.enumerated(spark, space).collect()
    assert space.size == 5 * 12 * 3 == len({r.variant for r in rows})
    with pytest.raises(ValueError):
        v.enumerated(spark, v.orders([v.text(str(i)) for i in range(21)]))
    with pytest.raises(ValueError):
        v.enumerated(spark, v.combine(v.variable("n"), v.text("a")))
    with pytest.raises(ValueError):
        v.with_once(v.once("k", v.text("a")))


def test_alignment_counts(spark):
    cases = [("a 1, 2\nb", "a 1, 2\nb", (0, 0, 0, 0)), ("a\nb", "a", (100, 0, 1, 0)), ("a", "a\nb", (100, 0, 0, 1)), ("b\na", "a\nb", (60, 0, 0, 0)), ("a 1, 2", "a 1, 3", (5, 1, 0, 0))]
    for own, aim, want in cases:
        docs, target = (spark.createDataFrame([(1, t)], "doc_id long, text string") for t in (own, aim))
        assert tuple(scoring.align_scores(docs, target).select("score", "mismatches", "insertions", "deletions").first()) == want


def test_bag_score_of_equal_and_null_texts(spark):
    df = spark.createDataFrame([(1, "x\nx\nx"), (2, "x"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.reorderings, r.insertions, r.deletions) for r in scoring.bag_scores(df, df.where("doc_id = 2")).collect()}
    assert got == {1: (1, 2, 0), 2: (1, 0, 0), 3: (0, 1, 1)}
    assert scoring.align_scores(df, df.where("doc_id = 2")).where("doc_id = 3").first().score == scoring.FAILED


def test_overlay_drops_unknown_keys(spark):
    base, over = ([("a", 1.0), ("b", 2.0)], [("b", 5.0), ("c", 9.0)])
    out = tables.overlay(*(spark.createDataFrame(x, "name string, weight double") for x in (base, over)))
    assert {tuple(r) for r in out.collect()} == {("a", 1.0), ("b", 5.0)}


def test_prefix_sums_and_reachability(spark):
    df = spark.range(2500).selectExpr("id", "id % 7 as w")
    got = {r.id: r.cum for r in ordered.prefix_sums(df, "id", "w", 100).collect()}
    total = 0
    for i in range(2500):
        total += i % 7
        assert got[i] == total
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src long, dst long")
    roots = spark.createDataFrame([(1,)], "node long")
    assert {(r.node, r.round) for r in tables.reachable(edges, roots).collect()} == {(1, 0), (2, 1), (3, 2)}


def test_sources(spark, tmp_path):
    for folder, names in (("a", ("base.c", "target.o", "compile.sh")), ("b", ("base.c",))):
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / n).write_bytes(b"x")
    missing = {r.folder.rsplit("/", 1)[1]: sorted(r.missing) for r in job_folders(spark, str(tmp_path)).collect()}
    assert missing == {"a": [], "b": ["compile.sh", "target.o"]}
    heads = [b"\x7fELF" + bytes([1, 2, 1]) + bytes(11) + bytes([0, 8]), b"\x7fELF" + bytes([1, 1, 1]) + bytes(11) + bytes([40, 0]), b"not an object file at all"]
    df = spark.createDataFrame([(bytearray(h),) for h in heads], "content binary")
    assert [r.m for r in df.select(elf_machine(df.content).alias("m")).collect()] == ["mips", "arm32", None]
    assert settings(str(tmp_path / "none.toml")) == {}


def test_normal_lines(spark):
    df = spark.createDataFrame([("add r1, 12 // note",), ("jump <loop+4>",), ("",)], "line string")
    assert [r.n for r in df.select(listing.normal(df.line).alias("n")).collect()] == ["add rimm, imm", "jump <target>", ""]
