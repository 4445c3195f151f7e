import random
from collections import Counter

import numpy as np
import xxhash

from quern.llm.simhash import bit_orders, fingerprint, forest, gray_rank, links, near_duplicates, permuted, search


def plain_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(keys, fps, distance):
    up = {i: i for i in range(len(fps))}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                up[root(i)] = root(j)
    lowest = {}
    for i, k in enumerate(keys):
        lowest[root(i)] = min(k, lowest.get(root(i), k))
    return {k: lowest[root(i)] for i, k in enumerate(keys)}


def clustered(rnd, size, flips):
    centres, codes = [rnd.getrandbits(64) for _ in range(max(1, size // 60))], set()
    while len(codes) < size:
        c = rnd.choice(centres)
        for b in rnd.sample(range(64), rnd.randint(0, flips)):
            c ^= 1 << b
        codes.add(c)
    return sorted(codes, key=lambda c: int(gray_rank(np.array([c], np.uint64))[0]))


def test_orders_let_every_near_pair_meet():
    rnd = random.Random(3)
    for distance in (1, 2, 3):
        orders, lead = bit_orders(distance, 0)
        for _ in range(2000):
            diff = set(rnd.sample(range(64), distance))
            assert any(not diff & set(o[:lead]) for o in orders)
    orders, lead = bit_orders(17, 5_000_000)
    assert lead == 13 and all(sorted(o) == list(range(64)) for o in orders)
    met = [any(not diff & set(o[:lead]) for o in orders) for diff in (set(rnd.sample(range(64), 10)) for _ in range(2000))]
    assert np.mean(met) > 0.99
    codes = np.array([rnd.getrandbits(64) for _ in range(50)], np.uint64)
    moved = permuted(codes, orders[0])
    assert [int(m) for m in moved] == [sum((int(c) >> b & 1) << 63 - i for i, b in enumerate(orders[0])) for c in codes]
    assert (gray_rank(codes) ^ gray_rank(codes) >> np.uint64(1) == codes).all()


def test_tree_search_equals_all_pairs_and_prunes_groups():
    rnd = random.Random(5)
    for size, flips, distance in ((1, 1, 2), (3, 3, 2), (40, 2, 2), (700, 4, 2), (2500, 5, 2), (900, 9, 14)):
        codes = np.array(clustered(rnd, size, flips), np.uint64)
        seen = Counter()
        a, b, apart = search(codes, codes, distance, True, seen)
        plain = np.bitwise_count(codes[:, None] ^ codes[None, :])
        want = {(i, j) for i, j in zip(*np.nonzero(plain <= distance)) if i < j}
        assert {(i, j) for i, j in zip(a.tolist(), b.tolist())} == want and len(a) == len(want)
        assert (apart == plain[a, b]).all()
        joined = forest(size, a, b, apart)
        kept = plain_components(range(size), codes.tolist(), distance)
        assert len(joined) == size - len(set(kept.values()))
        if size == 2500:  # whole groups above the leaves go, and few pairs are compared
            assert seen["spared"] > 0.1 * size * size and seen["compared"] < 0.3 * size * size
        x, y, _ = search(codes, codes[: size // 2], distance, False, Counter())
        assert {(i, j) for i, j in zip(x.tolist(), y.tolist())} == {(i, j) for i, j in zip(*np.nonzero(plain[: size // 2] <= distance))}


def test_cut_nodes_lose_no_link(spark):
    rnd = random.Random(9)
    codes = clustered(rnd, 600, 3) + [c ^ 1 << 5 ^ 1 << 40 for c in clustered(rnd, 30, 2)]
    codes += [rnd.getrandbits(64) for _ in range(200)]
    hot = rnd.getrandbits(64)
    codes = list(dict.fromkeys(codes + [hot ^ 1 << i ^ 1 << j for i in range(12) for j in range(i)]))
    signed = np.array(codes, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(c, c, 0, "x") for c in signed], "fp long, id long, more long, k string")
    for node in (None, 7):
        found = links(df, 2, node=node).collect()
        up = {c: c for c in signed}

        def root(c):
            while up[c] != c:
                c = up[c]
            return c

        for r in found:
            assert r.apart == ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2
            up[root(r.a)] = root(r.b)
        plain = plain_components(range(len(codes)), codes, 2)
        assert len({root(c) for c in signed}) == len(set(plain.values()))
    same = spark.createDataFrame([(5, i, 0) for i in range(50)], "fp long, id long, more long")  # one fingerprint of different texts
    assert links(same, 14, node=8).where("apart = 0").count() >= 49


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(50)] + ["É", "Ünï", "A\x0bB", "x\x85y"]
    texts = [None, "", " \n\t", "one", "One", "a b", "A B"]
    for _ in range(60):
        base = [rnd.choice(words) for _ in range(rnd.randint(3, 120))]
        texts.append(" ".join(base))
        for _ in range(rnd.randint(0, 4)):
            edit = list(base)
            edit[rnd.randrange(len(edit))] = rnd.choice(words)
            texts.append("\n".join(edit) if rnd.random() < 0.2 else " ".join(edit))
    texts.append("long " * 70000)
    rows = [(i, t, "noise", 5, 6) for i, t in enumerate(texts)] + [(3, "one", "noise", 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int, key int")
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in near_duplicates(df).collect()}
    fps = [plain_fingerprint(t or "") for t in texts]
    plain = plain_components(range(len(texts)), fps, 2)
    assert got == {i: (fps[i], plain[i]) for i in range(len(texts))}
    assert fingerprint("") == 0
    assert near_duplicates(df.limit(0)).collect() == []
