import math
import random
import time

import pytest
from pyspark.sql import functions as F

from quern.functions import macros, seeds
from quern.functions import variants as v


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 375, 1000, 4097])
def test_every_seed_goes_to_one_place(spark, n):
    for key in ("a", "b"):
        places = [r.place for r in seeds.shuffled(spark.range(n), "id", n, key).orderBy("id").collect()]
        assert sorted(places) == list(range(n))
        assert n < 100 or sum(abs(a - b) == 1 for a, b in zip(places, places[1:])) < 0.02 * n


def test_large_ranges_and_wrong_indices(spark):
    n = 2**61 + 12345
    rows = spark.range(3000).select((F.col("id") * 768614336404564).alias("i"))
    places = [r.place for r in seeds.shuffled(rows, "i", n, "k").collect()]
    assert len(set(places)) == 3000 and all(0 <= p < n for p in places)
    assert spark.range(1).select(seeds.permuted(F.lit(None).cast("long"), 9, "k").alias("p")).first().p is None
    with pytest.raises(Exception, match="outside"):
        seeds.shuffled(spark.range(5), "id", 4, "k").collect()
    with pytest.raises(ValueError):
        seeds.permuted(F.col("id"), 0, "k")


def test_endless_seeds_come_once_a_turn(spark, tmp_path):
    query = seeds.endless(spark, 50, "k", rows_per_batch=60).writeStream.format("memory").queryName("seeds").option("checkpointLocation", str(tmp_path)).start()
    try:
        while spark.table("seeds").count() < 180:
            time.sleep(0.2)
    finally:
        query.stop()
    turns = {}
    for r in spark.table("seeds").collect():
        turns.setdefault(r.turn, []).append(r.seed)
    whole = [turns[k] for k in (0, 1, 2)]
    assert all(sorted(t) == list(range(50)) for t in whole) and whole[0] != whole[1]


def plain_order(items, seed):
    rest, out = list(items), []
    while rest:
        seed, k = divmod(seed, len(rest))
        out.append(rest.pop(k))
    return out


def test_spaces_beyond_a_long(spark):
    names = [f"l{i}" for i in range(21)]
    space = v.orders([v.text(n) for n in names], " ")
    assert space.size == math.factorial(21) > 2**63
    rnd = random.Random(1)
    chosen = [0, 1, 2**63 - 1, 2**63, space.size - 1, *(rnd.randrange(space.size) for _ in range(30))]
    assert [(r.seed, r.variant) for r in v.at_seeds(spark, space, chosen).collect()] == [(str(s), " ".join(plain_order(names, s))) for s in chosen]
    small = v.orders([v.text("x"), v.text("y"), v.text("z")], ",")
    mixed = v.combine(v.integer(1, 7), v.text("/"), v.choice(v.text("first"), space, v.integer(5, 9)), v.text("/"), small)
    size = 7 * (1 + space.size + 5) * 6
    assert mixed.size == size
    want = {}
    for s in [*chosen, 7, 7 * (1 + space.size), 7 * (space.size + 3), size - 1]:
        rest, a = divmod(s, 7)
        rest, b = divmod(rest, 1 + space.size + 5)
        middle = "first" if b == 0 else " ".join(plain_order(names, b - 1)) if b <= space.size else str(5 + b - 1 - space.size)
        want[str(s)] = f"{a + 1}/{middle}/{','.join(plain_order('xyz', rest))}"
    assert {r.seed: r.variant for r in v.at_seeds(spark, mixed, [int(s) for s in want]).collect()} == want
    once = v.with_once(v.combine(v.once("k", space), v.once("k", v.text("!"))))
    got = {r.seed: r.variant for r in v.at_seeds(spark, once, [0, 1, 2 * 5, once.size - 1]).collect()}
    assert got == {"0": " ".join(names), "1": "!", "10": " ".join(plain_order(names, 5)), str(once.size - 1): "!"}
    wide = v.integer(-(10**30), 10**30)
    assert [r.variant for r in v.at_seeds(spark, wide, [0, 10**30 + 5]).collect()] == [str(-(10**30)), "5"]
    with pytest.raises(ValueError):
        v.at_seeds(spark, space, [space.size])


def test_random_spaces():
    assert macros.parsed("a PERM_GENERAL(b,PERM_RANDOMIZE(c))").random
    assert not macros.parsed("PERM_GENERAL(a,b)", auto_random=True).random
    plain = macros.parsed("int f(void) { return 1; }", auto_random=True)
    assert plain.random and plain.size == 1
    assert not macros.parsed("int f(void) { return 1; }").random
    assert macros.parsed("PERM_LINESWAP(PERM_RANDOMIZE(a)\nb)").random
