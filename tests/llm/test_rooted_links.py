import random

import numpy as np

from quern.llm.simhash import bit_orders, earlier, links, permuted


def closure(nodes, pairs):
    up = {c: c for c in nodes}

    def root(c):
        while up[c] != c:
            c = up[c]
        return c

    for a, b in pairs:
        up[root(a)] = root(b)
    return {c: root(c) for c in nodes}


def test_roots_and_chains(spark):
    rnd = random.Random(12)
    hot = rnd.getrandbits(64)
    codes = list({hot ^ 1 << i ^ 1 << j for i in range(14) for j in range(i)} | {rnd.getrandbits(64) for _ in range(60)})
    signed = np.array(codes, np.uint64).view(np.int64).tolist()
    near = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    some = {c: min(c, d) for c, d in near[::7]}
    rows = [(c, c, 0, some.get(c, c)) for c in signed]
    df = spark.createDataFrame(rows, "fp long, id long, more long, root long")
    known = [(c, r) for c, _, _, r in rows]
    want = closure({x for p in known for x in p} | set(signed), near + known)
    for node in (None, 7):
        found = [(r.a, r.b) for r in links(df, 2, node=node).collect()]
        roots = dict(known)
        assert found and all(roots[a] != roots[b] for a, b in found)
        got = closure(want, found + known)
        assert len(set(got.values())) == len(set(want.values()))
    # parts that follow each other join a run of one fingerprint
    same = spark.createDataFrame([(5, i, 0) for i in range(50)], "fp long, id long, more long")
    joined = closure(range(50), [(r.a, r.b) for r in links(same, 14, node=8, chain=True).collect()])
    assert len(set(joined.values())) == 1
    # one root: nothing is left to join
    one = spark.createDataFrame([(5, i, 0, 1) for i in range(50)], "fp long, id long, more long, root long")
    assert links(one, 14, node=8).isEmpty()


def test_leading_bits_of_the_orders_before():
    orders, lead = bit_orders(17, 1000)
    codes = np.array([random.Random(i).getrandbits(64) for i in range(50)], np.uint64)
    masks = earlier(orders, lead)
    for k in (0, 1, len(orders) - 1):
        own = permuted(codes, orders[k])
        assert len(masks[k]) == k
        for j in range(k):
            kept = sum(1 << b for b in orders[j][:lead])
            assert [(int(own[0] ^ x) & int(masks[k][j])) == 0 for x in own] == [(int(codes[0] ^ x) & kept) == 0 for x in codes]
