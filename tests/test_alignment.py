import difflib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.functions import listing
from quern.operators import alignment, scoring


def sequences(seed, n, letters, most):
    rnd = random.Random(seed)
    return {i: [rnd.choice(letters) for _ in range(rnd.randint(1, most))] for i in range(n)}


def rows_of(spark, texts):
    return spark.createDataFrame([(k, i, x) for k, t in texts.items() for i, x in enumerate(t)], "k long, pos long, name string").repartition(3)


@pytest.mark.parametrize("seed,letters,most", [(1, "ab", 12), (2, "abcdefgh", 30), (3, ["a", None], 9), (4, "a", 20)])
def test_steps_equal_a_serial_matcher(spark, seed, letters, most):
    texts = sequences(seed, 60, letters, most)
    target = [random.Random(seed + 9).choice(letters) for _ in range(most)]
    got = {}
    for r in alignment.steps(rows_of(spark, texts), rows_of(spark, {0: target}).drop("k"), "k", "pos", "name").collect():
        got.setdefault(r.key, []).append(tuple(r)[1:])
    for k, own in texts.items():
        assert sorted(got[k], key=lambda s: (s[1], s[3])) == difflib.SequenceMatcher(None, own, target, autojunk=False).get_opcodes()


def test_sequences_and_targets_without_rows(spark):
    empty = rows_of(spark, {0: ["a"]}).limit(0)
    keys = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    one = rows_of(spark, {1: ["a", "b"]})
    assert sorted(map(tuple, alignment.steps(one, empty.drop("k"), "k", "pos", "name").collect())) == [(1, "delete", 0, 2, 0, 0)]
    found = alignment.steps(one.where("k = 1"), rows_of(spark, {0: ["b"]}).drop("k"), "k", "pos", "name", keys.where("k is not null")).collect()
    assert sorted(map(tuple, found)) == [(1, "delete", 0, 1, 0, 0), (1, "equal", 1, 2, 0, 1), (2, "insert", 0, 0, 0, 1)]
    assert alignment.steps(empty, empty.drop("k"), "k", "pos", "name").collect() == []


def plain_differences(new, old, arch, stack, branches):
    """The field rules, serially: (stack, branch, register)."""
    kind, (a, name, a_symbol), (b, old_name, b_symbol) = listing.ARCHES[arch], new, old
    if a == b:
        return 0, 0, 0
    far = turned = 0
    x, y = re.search(kind.stack, a), re.search(kind.stack, b)
    cut = bool(stack and x and y)
    if cut:
        far = abs(int(x[1], 0) - int(y[1], 0))
    if branches and name == old_name and name in kind.branches and not a_symbol and not b_symbol and a.split(",")[-1] != b.split(",")[-1]:
        turned, cut = 1, True

    def fields(row):
        parts = row.split(None, 1)
        parts = parts[1].split(",") if len(parts) > 1 else []
        return parts[:-1] if cut else parts[:-1] + (re.split(r"(?<!%hi)(?<!%lo)\(", parts[-1]) if parts else [])

    p, q = fields(a), fields(b)
    wrong = sum(u != v and not (b_symbol and re.search(kind.symbol, u)) for u, v in zip(p, q)) + abs(len(p) - len(q))
    return far, turned, wrong


OPERANDS = {
    "mips": ["4(sp)", "0x10(sp)", "8(s8)", "a0", "zero", "%lo(.data)(v0)", "%lo(x)", "0x38(a1)", "L4", "L5", ".text+4"],
    "ppc": ["8(r1)", "-0x8(r1)", "r3", "sym@l", "@12", "@12@ha", "...data.0", "L1", "L2", "0(r13)"],
    "arm32": ["[sp, #4]", "[sp, #-0x1c]", "r0", ".text+0x34", "L1", "L2", "#3"],
    "x86": ["8(%ebp)", "-0x10(%esi)", "%eax", "L1", "L2", "$3"],
}
NAMES = {"mips": ["lw", "beq", "bnezl", "nop"], "ppc": ["lwz", "bne-", "blr"], "arm32": ["ldr", "bleq.n", "b"], "x86": ["mov", "jne", "call"]}


@pytest.mark.parametrize("arch", sorted(OPERANDS))
@pytest.mark.parametrize("stack,branches", [(True, True), (False, True), (True, False)])
def test_field_rules(spark, arch, stack, branches):
    rnd = random.Random(arch)

    def row():
        name = rnd.choice(NAMES[arch])
        rest = ",".join(rnd.choice(OPERANDS[arch]) for _ in range(rnd.randint(0, 3)))
        return (f"{name}\t{rest}" if rest else name, name, rnd.random() < 0.3)

    cases = [(row(), row()) for _ in range(300)]
    kind = "struct<row:string,name:string,has_symbol:boolean>"
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], f"i int, new {kind}, old {kind}")
    found = df.select("i", *(v.alias(k) for k, v in listing.differences(F.col("new"), F.col("old"), arch, stack, branches).items())).collect()
    for r in found:
        assert (r.stack, r.branch, r.register) == plain_differences(*cases[r.i], arch, stack, branches), cases[r.i]


def test_whole_score_equals_the_serial_rules(spark):
    rnd = random.Random(8)

    def row():
        name = rnd.choice(NAMES["mips"])
        return (f"{name}\t" + ",".join(rnd.choice(OPERANDS["mips"]) for _ in range(2)), name, rnd.random() < 0.3)

    target, texts = [row() for _ in range(12)], {i: [row() for _ in range(rnd.randint(1, 20))] for i in range(40)}
    for t in list(texts.values())[:15]:
        t[: len(target) // 2] = target[: len(target) // 2]
    schema = "k long, pos long, row string, name string, has_symbol boolean"
    df = spark.createDataFrame([(k, i, *x) for k, t in texts.items() for i, x in enumerate(t)], schema)
    aim = spark.createDataFrame([(0, i, *x) for i, x in enumerate(target)], schema).drop("k")
    found = {r.k: r for r in scoring.listing_scores(df, aim, "k", "pos", "mips").collect()}
    for k, own in texts.items():
        sums, more, less = [0, 0, 0], Counter(), Counter()
        for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, [x[1] for x in own], [x[1] for x in target], autojunk=False).get_opcodes():
            if tag == "equal":
                for x, y in zip(own[i1:i2], target[j1:j2]):
                    sums = [a + b for a, b in zip(sums, plain_differences(x, y, "mips", True, True))]
            else:
                more.update(x[0] for x in own[i1:i2])
                less.update(x[0] for x in target[j1:j2])
        both = sum((more & less).values())
        counts = (*sums, both, sum(more.values()) - both, sum(less.values()) - both)
        r = found[k]
        assert (r.stack, r.branch, r.register, r.reorderings, r.insertions, r.deletions) == counts
        assert r.score == sum(a * b for a, b in zip(counts, (1, 1, 5, 60, 100, 100)))


def test_distances_tell_types_with_one_initial_apart(spark):
    df = spark.createDataFrame([(1, 1, "view"), (1, 2, "vote"), (2, 1, "vote"), (2, 2, "view"), (3, 1, "view")], "u long, n long, t string")
    assert {r.u: r.distance for r in scoring.distances(df, 1, "u", "n", "t").collect()} == {1: 0, 2: 2, 3: 1}


def test_sequences_of_one_kind_are_aligned_once(spark, tmp_path):
    """By kinds the scores are those of every sequence alone, and little moves: a row of many short listings costs few bytes in any shuffle or table."""
    rnd = random.Random(6)
    rows = [(k, i, rnd.choice(["x", "y", None]), rnd.choice(["x 1", "y 2", "z", None])) for k in [None, *range(80)] for i in range(rnd.randint(1, 5))]
    schema = "k long, i int, name string, row string"
    many = spark.createDataFrame(list({(r[0], r[1]): r for r in rows}.values()), schema)
    target = spark.createDataFrame([(0, "x", "x 1"), (1, "y", "z"), (2, "x", None), (3, None, "y 2"), (4, "z", "w")], "i int, name string, row string")
    differ = {"register": (~F.col("new.row").eqNullSafe(F.col("old.row"))).cast("int")}
    got = alignment.scores_by_kind(many, target, "k", "i", "name", "row", differ, scoring.PENALTY).collect()
    want = alignment.scores(many, target, "k", "i", "name", "row", differ, scoring.PENALTY).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str) and len(got) == 81
    none = alignment.scores_by_kind(many, target.limit(0), "k", "i", "name", "row", differ, scoring.PENALTY).collect()
    assert {(r.key, r.insertions) for r in none if r.key is not None} == {(r.k, r.n) for r in many.where("k is not null").groupBy("k").count().withColumnRenamed("count", "n").collect()}
    assert alignment.scores_by_kind(many.limit(0), target, "k", "i", "name", "row", differ, scoring.PENALTY).collect() == []


def test_listing_scores_align_few_of_many_equal_listings(spark, monkeypatch):
    rows = spark.range(2000).selectExpr("id div 2 as k", "id % 2 as pos", "if(id % 2 = 0, 'lw', 'beq') as name", "concat('lw\\ta', id % 7, ',4(sp)') as row", "false as has_symbol")
    seen, whole = [], alignment.steps
    monkeypatch.setattr(alignment, "steps", lambda rows, *a: (seen.append(rows.count()), whole(rows, *a))[1])
    assert scoring.listing_scores(rows, rows.where("k = 0").drop("k"), "k", "pos", "mips").count() == 1000
    assert seen == [2]
