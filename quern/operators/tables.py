"""Overlays, roll-ups, fair order and reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.ranges import with_running
from quern.sources.tables import shared_folder, stored


#: Different tokens with a wildcard that a table of names is held against.
MOST_TOKENS = 10_000


def overlay(base: DataFrame, *layers: DataFrame, key: str = "name", value: str = "weight") -> DataFrame:
    """base's keys, each with the value of the last layer that has it; keys that only a layer has are dropped. Of a key that a layer
    repeats the largest value counts; a null value, as a null key, overlays nothing."""
    out = base
    for layer in layers:
        over = layer.groupBy(F.col(key).alias("_key")).agg(F.max(value).alias("_value"))
        out = out.join(over, out[key] == over["_key"], "left").withColumn(value, F.coalesce("_value", value)).drop("_key", "_value")
    return out


def decay(distance: Column, share: Column) -> Column:
    """The weight of a step of this distance: (distance + 1)^-1.5 plus an even share."""
    return F.pow(distance + 1, F.lit(-1.5)) + share


def uniform(key: Column, limit: Column) -> Column:
    """A whole number in [0, limit) from the first 60 bits of the key's SHA-256."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 15), 16, 10).cast("long") % limit


def fair_order(jobs: DataFrame, units: int, scale: int) -> DataFrame:
    """(job, unit, energy, position): units of equal duration by spent energy unit * scale / priority, ties by job.

    Positions are a running count by ranges. A null priority gives null energies, which come first; a priority of 0 is an error.
    """
    work = jobs.select("job", "priority", F.explode(F.sequence(F.lit(1), F.lit(units))).alias("unit"))
    work = work.withColumn("energy", F.call_function("div", F.col("unit").cast("long") * scale, F.col("priority").cast("long")))
    return with_running(work.drop("priority"), None, ["energy", "job", "unit"], F.lit(1).cast("long"), "position")


def fair_service(units: DataFrame, scale: int, least_priority: float | None = None) -> DataFrame:
    """(job, unit, energy, position) of units(job, unit, duration, priority) in the order in which one server takes them that always goes
    on with the job that has spent least: energy is the durations of the job's units before it, times scale / priority, ties by job.

    As a job's energy depends on its own units alone, the order is a sort by running sums, and both are scans by ranges. Jobs below
    least_priority are never served; durations are whole numbers, those below 0 or null count as 0.
    """
    rows = units if least_priority is None else units.where(F.col("priority") >= least_priority)
    duration = F.greatest(F.coalesce(F.col("duration").cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    spent = with_running(rows.withColumn("_duration", duration), "job", ["unit"], F.col("_duration"), "_spent")
    energy = F.call_function("div", (F.col("_spent") - F.col("_duration")) * scale, F.col("priority").cast("long"))
    served = spent.select("job", "unit", energy.alias("energy"))
    return with_running(served, None, ["energy", "job", "unit"], F.lit(1).cast("long"), "position")


def demand(df: DataFrame, key: str, order: str, halves: Column) -> DataFrame:
    """df with units: what a carried sum of half units makes whole at each row. A column of that name is replaced."""
    summed = with_running(df.withColumn("_halves", halves), key, [order], F.col("_halves"), "_sum")
    whole = F.floor(F.col("_sum") / 2) - F.floor((F.col("_sum") - F.col("_halves")) / 2)
    return summed.withColumn("units", whole).drop("_sum", "_halves")


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, round): what edges(src, dst) reach from roots(node), round by round, in as many rounds as the longest of the shortest ways has edges.

    Edges are stored once, different ones by src, and a round reads them along the new nodes alone. Nodes found are in one table a
    round; a node that many edges lead to is told once. Null nodes are reached by no edge and lead nowhere, but null roots stay.
    """
    known = stored(edges.where("src is not null and dst is not null").select("src", "dst").distinct().repartition("src"))
    new = stored(roots.select("node").distinct().withColumn("round", F.lit(0)))
    found = new
    k = 0
    while True:
        k += 1
        step = known.join(new.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        new = stored(step.join(found.select("node"), "node", "left_anti").withColumn("round", F.lit(k)))
        if new.isEmpty():
            return found
        found = found.union(new)
        if k % 20 == 0:
            found = stored(found)


def strong_and_weak(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, weak): what strong edges of edges(src, dst, weak) reach from roots(node), and, weak, the border that only weak edges from there reach.

    A weak edge needs no more than that its end is named: it leads to the border and not beyond, unless strong edges reach the end by
    another way. An edge that stands as weak and as strong is strong; a null of weak counts as strong.
    """
    weak = F.coalesce("weak", F.lit(False))
    strong = reachable(edges.where(~weak), roots).select("node")
    border = edges.where(weak & F.col("dst").isNotNull()).join(strong.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
    return strong.withColumn("weak", F.lit(False)).union(border.join(strong, "node", "left_anti").withColumn("weak", F.lit(True)))


def wildcard_edges(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """(token, name): names(name) that contain what stands before the final * of tokens(token). Tokens are compared with every name, so
    more than MOST_TOKENS different ones are an error."""
    few = tokens.distinct().limit(MOST_TOKENS + 1)
    if few.count() > MOST_TOKENS:
        raise ValueError(f"more than {MOST_TOKENS} tokens")
    part = F.expr("substring(token, 1, length(token) - 1)")
    return names.join(F.broadcast(few), F.col("token").endswith("*") & F.contains(F.col("name"), part)).select("token", "name")


def wildcard_closure(edges: DataFrame, tokens: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, round): what edges(src, dst) reach if a node that ends in * stands for every src that contains what is before it.

    tokens(token) are such nodes.
    """
    stands_for = wildcard_edges(tokens, edges.select(F.col("src").alias("name")).distinct())
    through = edges.join(stands_for, edges["src"] == stands_for["name"]).select(F.col("token").alias("src"), "dst")
    return reachable(edges.union(through).distinct(), roots)


def chain_ends(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, up): the end of each node's chain of links(node, up), by pointers that double their reach each round. Of a node that has
    several links the least counts; links of or to null are dropped.

    A cycle is an error. Nodes that many chains lead to are a hot key of the join, which adaptive skew handling splits.
    """
    shared_folder(links.sparkSession)
    at = links.where("node is not null and up is not null").groupBy("node").agg(F.min("up").alias("up")).checkpoint()
    for _ in range(max_rounds):
        further = at.select(F.col("node").alias("up"), F.col("up").alias("_end"))
        at = at.join(further, "up", "left").select("node", F.coalesce("_end", "up").alias("up"), F.col("_end").isNotNull().alias("_moved")).checkpoint()
        if at.where("_moved").isEmpty():
            return at.drop("_moved")
        at = at.drop("_moved")
    raise RuntimeError(f"chains don't end after {max_rounds} rounds: is there a cycle?")


def around_pivot(df: DataFrame, key: str, order: str, pivot: Column, salt: str, whole: int = 20, side: int = 20) -> DataFrame:
    """A random subset of each key's rows that holds its pivot, the row whose order is `pivot`.

    Each other row by an even coin, in half of the keys, and none in the rest; of `whole` percent of the keys all rows; of `side`
    percent of the others all rows on one side. Draws follow from SHA-256 of key, order and salt.
    """

    def drawn(name: str, limit: int, *parts: str) -> Column:
        return uniform(F.concat_ws(":", *(F.col(p).cast("string") for p in (key, *parts)), F.lit(salt + name)), F.lit(limit))

    coin = (drawn("half", 2) == 0) & (drawn("row", 2, order) == 0)
    one_side = (drawn("side", 100) < side) & F.when(drawn("which", 2) == 0, F.col(order) < pivot).otherwise(F.col(order) > pivot)
    return df.where((F.col(order) == pivot) | coin | (drawn("whole", 100) < whole) | one_side)
