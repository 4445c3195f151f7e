"""All seeds of a space once, in an order that looks random, without sorting or remembering them."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime below 2**31, so that products stay below 2**62, and rounds of the network.
PRIME, ROUNDS = 2**31 - 1, 6
#: Steps back into the range; a number needs another one with a chance below 1 / sqrt(n), and never more than sqrt(n) + 1.
WALK = 64
LIMIT = 2**62


def keys(key: str) -> list[tuple[int, int, int]]:
    """The constants of each round."""
    out = []
    for k in range(ROUNDS):
        digest = hashlib.sha256(f"{k}:{key}".encode()).digest()
        out.append(tuple(int.from_bytes(digest[i : i + 8], "big") % (PRIME - 1) + 1 for i in (0, 8, 16)))
    return out


def _mod(a: Column, n: int) -> Column:
    return F.call_function("mod", a, F.lit(n).cast("long"))


def permuted(index: Column, n: int, key: str, turn: Column | None = None) -> Column:
    """Where `index` of [0, n) goes in a permutation of [0, n) that follows from key and turn, both in turn numbers from 0.

    A Feistel network on the two digits of the index in the bases a = ceil(sqrt(n)) and b = ceil(n / a): each round adds to one
    digit what follows from the other, so all of it can be undone. What lands on n or above walks on until it is below. An index
    outside of [0, n) is an error, null gives null. n is at most 2**62.
    """
    if not 0 < n <= LIMIT:
        raise ValueError(f"{n} is no size up to 2**62")
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    whole, turned = F.lit(n).cast("long"), F.lit(0).cast("long") if turn is None else turn.cast("long")

    def step(x: Column) -> Column:
        pair = F.struct(F.call_function("div", x, F.lit(b).cast("long")).alias("l"), _mod(x, b).alias("r"))
        for k, (times, more, by_turn) in enumerate(keys(key)):
            side, other = ("l", "r") if k % 2 == 0 else ("r", "l")
            size = a if side == "l" else b

            def rounded(p: Column) -> Column:
                f = _mod((_mod(p[other], PRIME) * times + more + _mod(turned, PRIME) * (by_turn % 2**20)), PRIME)
                # The product's low part alone is a line; its square mixes the other digit's bits.
                new = _mod(p[side] + _mod(_mod(f * f, PRIME), size), size)
                return F.struct(*((new if name == side else p[name]).alias(name) for name in ("l", "r")))

            pair = F.transform(F.array(pair), rounded)[0]
        return F.transform(F.array(pair), lambda p: p["l"] * b + p["r"])[0]

    inside = F.when((index >= 0) & (index < whole), index.cast("long")).when(index.isNotNull(), F.raise_error("an index outside of the permutation").cast("long"))
    most = min(WALK, a * b - n)  # numbers that walk never meet more others
    first = step(inside)
    if not most:
        return first
    done = F.aggregate(F.sequence(F.lit(1), F.lit(most)), first, lambda x, _: F.when(x < whole, x).otherwise(step(x)))
    return F.when(done < whole, done).when(done.isNotNull(), F.raise_error("the walk is too long").cast("long"))


def shuffled(df: DataFrame, index: str, n: int, key: str, name: str = "place") -> DataFrame:
    """df with name: where its index goes. Without a sort or a shuffle."""
    return df.withColumn(name, permuted(F.col(index), n, key))


def endless(spark: SparkSession, n: int, key: str, rows_per_batch: int = 100_000) -> DataFrame:
    """A stream of (turn, seed) without an end: every seed of [0, n) once, in an order of its own for each turn, then the next turn.

    For spaces that are random beyond their seed, where a seed that comes again gives another variant.
    """
    rows = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).option("numPartitions", spark.sparkContext.defaultParallelism).load()
    turn = F.call_function("div", F.col("value"), F.lit(n).cast("long"))
    return rows.select(turn.alias("turn"), permuted(_mod(F.col("value"), n), n, key, turn).alias("seed"))


def step_sql(x: str, key: str) -> str:
    """DuckDB SQL of one pass of the network at turn 0 over the expression x, with the bases as columns a and b."""
    state = f"struct_pack(l := {x} // b, r := {x} % b)"
    for k, (times, more, _) in enumerate(keys(key)):
        side, other, size = ("l", "r", "a") if k % 2 == 0 else ("r", "l", "b")
        f = f"(((p.{other} % {PRIME}) * {times} + {more}) % {PRIME})"
        new = f"(p.{side} + {f} * {f} % {PRIME} % {size}) % {size}"
        state = f"list_transform([{state}], lambda p: struct_pack(l := {new if side == 'l' else 'p.l'}, r := {new if side == 'r' else 'p.r'}))[1]"
    return f"list_transform([{state}], lambda p: p.l * b + p.r)[1]"
