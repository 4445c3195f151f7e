import random

import pytest

from quern.functions import listing, macros
from quern.operators import ordered, scoring, tables
from quern.sources.tables import weight_rows


def test_relocations_rewrite_the_row_before(spark):
    rows = ["R_PPC_REL24 early", "bl\t0", "R_PPC_REL24 call", "lwz\tr3,8(r4)", "R_PPC_ADDR16_LO name", "nop"]
    df = spark.createDataFrame([(1, i, r) for i, r in enumerate(rows)], "fn long, pos int, row string")
    got = [(r.row, r.has_symbol) for r in ordered.with_relocations(df, "fn", "pos", "row", "ppc", "R_PPC_").orderBy("pos").collect()]
    assert got == [("bl\tcall", True), ("lwz\tr3,name@l(r4)", True), ("nop", False)]
    cases = [("lui\ta0,0", "R_MIPS_HI16 x", "lui\ta0,%hi(x)"), ("lw\ta0,-4(v0)", "R_MIPS_LO16 x", "lw\ta0,%lo(x-4)(v0)"), ("jal\t0", "R_MIPS_26 f", "jal\tf"), ("jr\tt9", "R_MIPS_JALR f", "jr\tt9")]
    df = spark.createDataFrame(cases, "line string, note string, want string")
    assert [(r.got, r.want) for r in df.select(listing.relocated(df.line, df.note, "mips").alias("got"), "want").collect()] == [(c[2], c[2]) for c in cases]
    with pytest.raises(Exception, match="unknown relocation"):
        df.select(listing.relocated(df.line, df.note, "ppc")).collect()


def test_numbers_and_names(spark):
    cases = [("add 12,-34 r10 0x20 7 x_11", "add 0xc,-0x22 r10 0x20 7 x_11"), ("", "")] + [(str(n), hex(n)) for n in (10**18 - 1, 10**18, 10**19, int("9" * 30), 16**40, 7**99)]
    df = spark.createDataFrame(cases, "a string, b string")
    assert [r[0] for r in df.select(listing.numbers_as_hex(df.a)).collect()] == [c[1] for c in cases]
    ints = {"0x1F": 31, "-0b11": -3, "0o17": 15, "12": 12, "00": 0, "012": None, "": None, "x": None, "9" * 30: None}
    df = spark.createDataFrame([(k,) for k in ints], "t string")
    assert {r[0]: r[1] for r in df.select("t", listing.based_int(df.t)).collect()} == ints
    sources = {"int f(int a) {\n if(a) {}\n}": "f", "PERM_X(a) {": None, "": None, "void a() {} void b()\n{}": "b"}
    df = spark.createDataFrame([(k,) for k in sources], "t string")
    assert {r[0]: r[1] for r in df.select("t", listing.function_name(df.t)).collect()} == sources


def test_regions_must_match(spark):
    df = spark.createDataFrame([(1, "a\n#pragma region pretend\nb\n#pragma endregion pretend\n\n"), (2, None), (3, "")], "seed long, variant string")
    assert {r.seed: r.variant for r in macros.finished(df, "seed").collect()} == {1: "a\n", 2: None, 3: "\n"}
    for bad in ("#pragma region pretend\nb", "#pragma endregion force_sameline"):
        with pytest.raises(Exception, match="don't match"):
            macros.finished(spark.createDataFrame([(1, bad)], "seed long, variant string"), "seed").collect()


def test_steps_lead_to_the_target(spark):
    rnd = random.Random(3)
    target = [rnd.choice("abc") for _ in range(9)]
    texts = {i: [rnd.choice("abcd") for _ in range(rnd.randint(1, 12))] for i in range(40)}
    docs = spark.createDataFrame([*((i, "\n".join(t)) for i, t in texts.items()), (99, None)], "doc_id long, text string")
    aim = lambda rows: spark.createDataFrame([(0, "\n".join(rows))], "doc_id long, text string")
    steps = scoring.opcodes(docs, aim(target)).orderBy("doc_id", "i1", "j1").collect()
    for i, own in texts.items():
        made = [x for s in steps if s.doc_id == i for x in (own[s.i1 : s.i2] if s.tag == "equal" else target[s.j1 : s.j2])]
        assert made == target
    assert 99 not in {s.doc_id for s in steps}
    diff = scoring.line_diff(spark.createDataFrame([(1, " a\nb \nx")], "doc_id long, text string"), aim(["a", "b", "c"])).collect()
    assert {(r.sign, r.line_no) for r in diff} == {("+", 2), ("-", 2)}


def test_chains_and_pivots(spark):
    links = spark.createDataFrame([(i, i - 1) for i in range(1, 40)], "node long, up long")
    assert {r.up for r in tables.chain_ends(links).collect()} == {0}
    with pytest.raises(RuntimeError):
        tables.chain_ends(spark.createDataFrame([(1, 2), (2, 1)], "node long, up long"), 5)
    rows = spark.range(4000).selectExpr("id div 4 as k", "id % 4 as n")
    kept = tables.around_pivot(rows, "k", "n", tables.F.lit(2), "s").groupBy("k").agg(tables.F.collect_set("n").alias("ns")).collect()
    assert len(kept) == 1000 and all(2 in r.ns for r in kept) and {len(r.ns) for r in kept} == {1, 2, 3, 4}


def test_weights(spark, tmp_path):
    (tmp_path / "w.toml").write_text("[base]\na = 1\nb = 2\n[own]\nb = 5\n")
    rows = weight_rows(spark, str(tmp_path / "w.toml"), "base", "own", "none")
    layers = [rows.where(rows.layer == k).select("name", "weight") for k in range(3)]
    assert {tuple(r) for r in tables.overlay(*layers).collect()} == {("a", 1.0), ("b", 5.0)}


def test_the_query_numbers_line_items_once(spark):
    """No join of the table with itself: one sort by order, and rows without an order stay, as in the SQL."""
    import contextlib
    import io

    from quern import catalog

    shown, real = [], ordered.with_relocations

    def seen(df, *args):
        with contextlib.redirect_stdout(io.StringIO()) as out:
            df.explain()
        shown.append(out.getvalue())
        return real(df, *args)

    ordered.with_relocations = seen
    try:
        assert catalog.QUERIES["relocations"](spark, "/root/testdata/sf0.001").count() > 1000
    finally:
        ordered.with_relocations = real
    assert "Join" not in shown[0] and shown[0].count("Exchange") == 1
