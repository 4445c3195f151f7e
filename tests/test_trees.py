import random

from pyspark.sql import functions as F

from quern.operators import tables, trees


def random_tokens(seed, trees_=12, n=60):
    rnd = random.Random(seed)
    return [(rnd.choice([None, *range(trees_)]), i, rnd.choice([1, 1, 1, -1, -1, -1, 0]), rnd.choice(["a", "b", None])) for i in range(trees_ * n)]


def plain_nodes(tokens):
    """{(tree, node): (label, depth, parent, nth, end)} by a stack."""
    out, stacks, counts = {}, {}, {}
    for tree, pos, step, label in tokens:
        stack = stacks.setdefault(tree, [])
        if step >= 0:
            parent = stack[-1] if stack else None
            counts[tree, parent] = counts.get((tree, parent), 0) + 1
            out[tree, pos] = [label, len(stack), parent, counts[tree, parent], pos if step == 0 else None]
            if step:
                stack.append(pos)
        elif stack:
            out[tree, stack.pop()][4] = pos
    return {k: tuple(x) for k, x in out.items()}


def plain_shapes(found):
    children = {}
    for (tree, node), x in sorted(found.items(), key=lambda i: i[0][1]):
        children.setdefault((tree, x[2]), []).append(node)

    def shape(tree, node):
        inner = [shape(tree, c) for c in children.get((tree, node), [])]
        return (found[tree, node][0], tuple(x[0] for x in inner)), 1 + sum(x[1] for x in inner)

    return {k: shape(*k) for k in found}


def test_nodes_equal_a_stack(spark):
    for seed in (1, 2):
        tokens = random_tokens(seed)
        df = spark.createDataFrame(tokens, "tree long, pos long, step int, label string").repartition(3)
        got = {(r.tree, r.node): (r.label, r.depth, r.parent, r.nth, r.end) for r in trees.nodes(df).collect()}
        assert got == plain_nodes(tokens)


def test_equal_subtrees_have_equal_hashes(spark):
    tokens = random_tokens(3, n=120)
    df = spark.createDataFrame(tokens, "tree long, pos long, step int, label string")
    shapes = plain_shapes(plain_nodes(tokens))
    found = trees.hashed(trees.nodes(df))
    rows = found.collect()
    by_hash, by_shape = {}, {}
    for r in rows:
        s = shapes[r.tree, r.node]
        assert r.size == s[1]
        by_hash.setdefault(r.hash, set()).add(s)
        by_shape.setdefault(s, set()).add(r.hash)
    assert all(len(x) == 1 for x in (*by_hash.values(), *by_shape.values()))
    places = {}
    for k, s in shapes.items():
        places.setdefault(s, []).append((k[0] is not None, k[0] or 0, k[1]))
    want = sorted((s[1], len(p), *min(p)) for s, p in places.items() if len(p) > 1 and s[1] >= 3)
    assert sorted((r.size, r.n, r.tree is not None, r.tree or 0, r.node) for r in trees.repeated(found, 3).collect()) == want
    assert trees.hashed(trees.nodes(df.limit(0))).collect() == []


def test_shared_bodies(spark):
    make = lambda k, text: [(k, i, {"(": 1, ")": -1}.get(c, 0), "g" if c in "()" else c) for i, c in enumerate(text)]
    left, right = (trees.hashed(trees.nodes(spark.createDataFrame(make(k, t), "tree long, pos long, step int, label string"))) for k, t in ((1, "(x(ab)(c))y"), (2, "((ab)z)y((ab))")))
    assert sorted(map(tuple, trees.same_place(left, right).collect())) == [(1, 2, 2, 1), (1, 10, 2, 7)]


def test_bodies_are_stripped(spark):
    text = "int g;\nint f(int a) {\n  if (a) {\n    b();\n  }\n}\nvoid k(void)\n{\n  c();\n}\nint one(void) { return 1; }\nint end;"
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(text.split("\n"))], "doc long, n long, line string")
    shown = lambda kept: "\n".join(r.line for r in trees.without_bodies(rows, "doc", "n", "line", kept).orderBy("n").collect())
    assert shown(None) == "int g;\nint f(int a);\nvoid k(void)\n;\nint one(void);\nint end;"
    kept = spark.createDataFrame([(1, "f"), (1, "on"), (2, "one")], "doc long, name string")
    assert shown(kept) == "int g;\nint f(int a) {\n  if (a) {\n    b();\n  }\n}\nvoid k(void)\n;\nint one(void);\nint end;"


def test_strong_and_weak_edges(spark):
    rnd = random.Random(4)
    edges = [(rnd.randint(0, 30), rnd.randint(0, 30), rnd.choice([True, True, False, None])) for _ in range(60)]
    df = spark.createDataFrame([*edges, (None, 3, False), (3, None, True)], "src long, dst long, weak boolean")
    strong, todo = set(), [0, 1]
    while todo:
        x = todo.pop()
        if x not in strong:
            strong.add(x)
            todo += [b for a, b, w in edges if a == x and not w]
    weak = {b for a, b, w in edges if w and a in strong} - strong
    roots = spark.createDataFrame([(0,), (1,), (1,)], "node long")
    assert weak and {(r.node, r.weak) for r in tables.strong_and_weak(df, roots).collect()} == {(x, False) for x in strong} | {(x, True) for x in weak}


def test_long_chains_are_reached(spark):
    edges = spark.range(45).selectExpr("id as src", "id + 1 as dst")
    found = tables.reachable(edges, spark.createDataFrame([(0,)], "node long"))
    assert found.agg(F.count("*").alias("n"), F.max("round").alias("r")).first() == (46, 45)
