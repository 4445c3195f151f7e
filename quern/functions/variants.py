"""Spaces of text variants as Column expressions over a whole-number seed.

Each space has a size and decodes a seed in [0, size) to text. Combined spaces use mixed radix, the leftmost part being the
least significant digit. Spaces are put together in Python, or read from macro text by `macros.parsed`.

Seeds of a space of 2**63 variants or more are decimal texts; a small helper takes them apart exactly, until the parts count below 2**63
and go on as longs. So results don't depend on the size. Null seeds give null.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LIMIT = 2**63


@dataclass(frozen=True)
class Space:
    """size, decode(seed, choices): text; once: keys of which one occurrence in the whole space is shown; random: whether a seed
    gives more than one variant, because code in it is marked to be randomised."""

    size: int
    decode: Callable[[Column, dict], Column]
    once: tuple[str, ...] = field(default=())
    random: bool = False


def text(value: str) -> Space:
    return Space(1, lambda seed, chosen: F.lit(value))


def integer(low: int, high: int) -> Space:
    size = high - low + 1
    if size >= LIMIT or abs(low) >= LIMIT or abs(high) >= LIMIT:
        return Space(size, lambda seed, chosen: _taken(seed.cast("string"), [1], low)[1])
    return Space(size, lambda seed, chosen: (seed + F.lit(low)).cast("string"))


def _taken(seed: Column, sizes: list[int], more: int = 0) -> Column:
    """array<string>: the mixed-radix digits of a decimal text, then what is left plus `more`. Exact at any size."""

    @F.pandas_udf("array<string>")
    def take(seeds: pd.Series) -> pd.Series:
        def digits(value: str | None) -> list[str] | None:
            if value is None:
                return None
            rest, out = int(value), []
            for n in sizes:
                rest, digit = divmod(rest, n)
                out.append(str(digit))
            return [*out, str(rest + more)]

        return seeds.map(digits)

    return take(seed)


def _located(seed: Column, sizes: list[int]) -> Column:
    """array<string>: which of consecutive ranges of these sizes a decimal text lies in, and where in it."""

    @F.pandas_udf("array<string>")
    def locate(seeds: pd.Series) -> pd.Series:
        def place(value: str | None) -> list[str] | None:
            if value is None:
                return None
            rest = int(value)
            for k, n in enumerate(sizes):
                if rest < n:
                    return [str(k), str(rest)]
                rest -= n
            return None

        return seeds.map(place)

    return locate(seed)


def _sized(digit: Column, size: int) -> Column:
    """A digit as its space takes it: a long, or a decimal text for a large one."""
    return digit.cast("long") if size < LIMIT else digit


def _div(a: Column, b: int | Column) -> Column:
    """Whole-number division."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b).cast("long"))


def _mod(a: Column, b: int | Column) -> Column:
    return F.call_function("mod", a, b if isinstance(b, Column) else F.lit(b).cast("long"))


def _digits(seed: Column, sizes: list[int]) -> list[Column]:
    """Digit k is (seed div the product of the sizes before it) mod its own size."""
    if math.prod(sizes) >= LIMIT:
        taken = _taken(seed, sizes)
        return [_sized(taken[k], n) for k, n in enumerate(sizes)]
    out, below = [], 1
    for n in sizes:
        out.append(_mod(_div(seed, below) if below > 1 else seed, n))
        below *= n
    return out


def combine(*parts: Space) -> Space:
    def decode(seed: Column, chosen: dict) -> Column:
        return F.concat(*(part.decode(digit, chosen) for part, digit in zip(parts, _digits(seed, [p.size for p in parts]))))

    return Space(math.prod(p.size for p in parts), decode, tuple(k for p in parts for k in p.once), any(p.random for p in parts))


def choice(*parts: Space) -> Space:
    """A sum: the seed counts through the first part, then the second, and so on. A variable that a part sets is set where that
    part is shown."""

    total = sum(p.size for p in parts)

    def decode(seed: Column, chosen: dict) -> Column:
        at, shown, after = [0], [], []
        where = _located(seed, [p.size for p in parts]) if total >= LIMIT else None
        for part in parts:
            after.append(dict(chosen))
            # A large seed's place is only read as a long where it lies in this part.
            own = seed - at[-1] if where is None else F.when(where[0] == str(len(shown)), _sized(where[1], part.size))
            shown.append(part.decode(own, after[-1]))
            at.append(at[-1] + part.size)

        def picked(values: list[Column]) -> Column:
            out = values[-1]
            for k in range(len(values) - 2, -1, -1):
                out = F.when(seed < at[k + 1] if where is None else where[0] == str(k), values[k]).otherwise(out)
            return out

        for name in {k for own in after for k in own if own[k] is not chosen.get(k)}:
            chosen[name] = picked([own[name] if name in own else F.raise_error(F.lit(f"{name[1:]} is read before it is set")) for own in after])
        return picked(shown)

    return Space(total, decode, tuple(k for p in parts for k in p.once), any(p.random for p in parts))


def orders(parts: list[Space], between: str = "\n") -> Space:
    """All orders of the parts (the low digits), times what the parts themselves offer."""
    n = len(parts)

    def decode(seed: Column, chosen: dict) -> Column:
        digits = _digits(seed, [*range(n, 0, -1), *(p.size for p in parts)])  # how many of those left stand before the next one
        texts = F.array(*(p.decode(d, chosen) for p, d in zip(parts, digits[n:])))
        start = F.struct(texts.alias("rest"), F.expr("cast(array() as array<string>)").alias("out"))

        def take(state: Column, digit: Column) -> Column:
            at = digit.cast("int")
            rest = F.concat(F.slice(state["rest"], F.lit(1), at), F.slice(state["rest"], at + 2, F.size(state["rest"])))
            return F.struct(rest.alias("rest"), F.concat(state["out"], F.array(F.get(state["rest"], at))).alias("out"))

        return F.aggregate(F.array(*digits[:n]), start, take, lambda s: F.array_join(s["out"], between))

    return Space(math.factorial(n) * math.prod(p.size for p in parts), decode, tuple(k for p in parts for k in p.once), any(p.random for p in parts))


def once(key: str, part: Space) -> Space:
    """Of all places with this key exactly one is shown; `enumerated` decodes which one first."""

    def decode(seed: Column, chosen: dict) -> Column:
        if key not in chosen:
            raise ValueError(f"{key} is not decoded here")
        at = chosen[key]["next"]
        chosen[key]["next"] += 1
        return F.when(chosen[key]["digit"] == at, part.decode(seed, chosen)).otherwise(F.lit(""))

    return Space(part.size, decode, (*part.once, key), part.random)


def with_once(body: Space) -> Space:
    """body behind one leading digit for each of its once keys."""
    keys = list(dict.fromkeys(body.once))
    counts = [body.once.count(k) for k in keys]
    if 1 in counts:
        raise ValueError("a key that stands at one place only")

    def decode(seed: Column, chosen: dict) -> Column:
        *own, rest = _digits(seed, [*counts, body.size])
        return body.decode(rest, chosen | {k: {"digit": d, "next": 0} for k, d in zip(keys, own)})

    return Space(math.prod(counts) * body.size, decode, random=body.random)


def set_variable(name: str, part: Space) -> Space:
    """Shows nothing, and keeps the part's text for `variable` further right."""

    def decode(seed: Column, chosen: dict) -> Column:
        chosen[f"${name}"] = part.decode(seed, chosen)
        return F.lit("")

    return Space(part.size, decode, part.once, part.random)


def variable(name: str) -> Space:
    def decode(seed: Column, chosen: dict) -> Column:
        if f"${name}" not in chosen:
            raise ValueError(f"{name} is read before it is set")
        return chosen[f"${name}"]

    return Space(1, decode)


def enumerated(spark: SparkSession, space: Space) -> DataFrame:
    """(seed, variant) for every seed of the space, made where they are used. Raises ValueError for 2**63 variants or more."""
    if space.size >= LIMIT:
        raise ValueError(f"{space.size} variants are more than a long counts")
    return decoded(spark.range(space.size), "id", space)


def at_seeds(spark: SparkSession, space: Space, seeds: list[int]) -> DataFrame:
    """(seed, variant) for the given seeds. Raises ValueError for one that is outside of the space."""
    if wrong := [s for s in seeds if not 0 <= s < space.size]:
        raise ValueError(f"{wrong} are no seeds of {space.size} variants")
    large = space.size >= LIMIT
    return decoded(spark.createDataFrame([(str(s) if large else s,) for s in seeds], f"seed {'string' if large else 'long'}"), "seed", space)


def decoded(seeds: DataFrame, seed: str, space: Space) -> DataFrame:
    """(seed, variant) of seeds, which are longs, or decimal texts where the space has 2**63 variants or more."""
    return seeds.select(F.col(seed).alias("seed"), space.decode(F.col(seed), {}).alias("variant"))
