"""Trees as tables of nodes: read from brackets by their depth, hashed from the leaves up, compared by hash.

Depths and parents come from scans by ranges, so a tree may be of any size; a round of hashing takes all nodes of one depth, and a
node's children are summed up to a number, a count and two sums of bits before the shuffle, so it may have any number of them. There are
as many rounds as the deepest tree has levels.

Defined cases: a closing bracket without an open one is dropped, an open one that isn't closed ends with its tree; null labels are
labels; a tree without brackets has no nodes. (tree, pos) must tell tokens apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.ranges import with_last_before, with_running
from quern.sources.tables import stored


def nodes(tokens: DataFrame) -> DataFrame:
    """(tree, node, label, depth, parent, nth, end) of tokens(tree, pos, step, label): step 1 opens a node, -1 closes one, and 0 is a leaf.

    node is the position of the token that opens it, nth its place among its siblings, end the position of the token that closes it,
    its own for a leaf, null where there is none.
    """
    rows = tokens.select("tree", "pos", F.coalesce(F.col("step").cast("long"), F.lit(0)).alias("step"), "label")
    # A closing bracket without an open one is where the sum of steps falls below all sums before it.
    summed = with_running(rows, "tree", ["pos"], F.col("step"), "sum")
    least = with_running(summed, "tree", ["pos"], F.least(F.col("sum"), F.lit(0).cast("long")), "least", F.min)
    before = with_running(least, "tree", ["pos"], F.col("least"), "before", F.min, own=False, none=F.lit(0).cast("long"))
    deep = before.where((F.col("step") >= 0) | (F.col("sum") >= F.col("before"))).select("tree", "pos", "step", "label", (F.col("sum") - F.col("least")).alias("depth"))
    deep = stored(deep.withColumn("depth", F.when(F.col("step") == 1, F.col("depth") - 1).otherwise(F.col("depth"))))  # that of the node, from 0
    # Of each depth, a node's closing token is the next one, and its parent the last one that is open a level above.
    level = lambda d: F.struct("tree", d.alias("depth"))
    ends = deep.where("step <> 0").withColumn("_level", level(F.col("depth"))).withColumn("_place", F.when(F.col("step") == -1, F.col("pos")))
    closed = with_last_before(ends.withColumn("_back", -F.col("pos")), "_level", ["_back"], F.col("_place"), "end").where("step = 1").select("tree", F.col("pos").alias("node"), "end")
    above = deep.where("step = 1").select(level(F.col("depth")).alias("_level"), "pos", F.col("pos").alias("_open"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("long").alias("depth"), F.lit(None).cast("long").alias("step"))
    asking = deep.where("step >= 0").select(level(F.col("depth") - 1).alias("_level"), "pos", F.lit(None).cast("long").alias("_open"), "label", "depth", "step")
    found = with_last_before(above.union(asking), "_level", ["pos"], F.col("_open"), "parent").where("depth is not null")
    named = found.select(F.col("_level.tree").alias("tree"), F.col("pos").alias("node"), "label", "depth", F.when(F.col("depth") > 0, F.col("parent")).alias("parent"), "step")
    numbered = with_running(named.withColumn("_family", F.struct("tree", "parent")), "_family", ["node"], F.lit(1).cast("long"), "nth").drop("_family")
    joined = numbered.join(closed.withColumnRenamed("tree", "_tree").withColumnRenamed("node", "_node"), F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("node") == F.col("_node")), "left")
    return joined.select("tree", "node", "label", "depth", "parent", "nth", F.when(F.col("step") == 0, F.col("node")).otherwise(F.col("end")).alias("end"))


def hashed(found: DataFrame) -> DataFrame:
    """nodes with hash and size (nodes in its subtree): equal for subtrees of equal labels in the same order and nesting."""
    rows = stored(found)
    deepest = rows.agg(F.max("depth")).first()[0]
    own = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("-"))
    below, done = None, []
    for depth in range(deepest, -1, -1) if deepest is not None else ():
        level = rows.where(F.col("depth") == depth)
        if below is None:
            level = level.select("*", F.lit(0).cast("long").alias("_n"), *(F.lit(0).cast("long").alias(c) for c in ("_a", "_b")), F.lit(0).cast("long").alias("_size"))
        else:
            children = below.groupBy(F.col("tree").alias("_tree"), F.col("parent").alias("_parent")).agg(
                F.count("*").alias("_n"), F.bit_xor(F.xxhash64("nth", "hash")).alias("_a"), F.bit_xor(F.xxhash64("hash", "nth", F.lit(1))).alias("_b"), F.sum("size").alias("_size")
            )
            joined = level.join(children, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("node") == F.col("_parent")), "left").drop("_tree", "_parent")
            level = joined.select(*rows.columns, *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("_n", "_a", "_b", "_size")))
        digest = F.sha2(F.concat_ws(":", *(F.col(c).cast("string") for c in ("_n", "_a", "_b")), own), 256)
        below = stored(level.select(*rows.columns, digest.alias("hash"), (F.col("_size") + 1).alias("size")))
        done.append(below)
    if not done:
        return rows.select("*", F.lit(None).cast("string").alias("hash"), F.lit(0).cast("long").alias("size"))
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def repeated(found: DataFrame, least_size: int = 2) -> DataFrame:
    """(hash, size, n, tree, node) of hashed nodes: subtrees of `least_size` nodes or more that stand at several places, n, and the first of them."""
    groups = found.where(F.col("size") >= least_size).groupBy("hash", "size").agg(F.count("*").alias("n"), F.min(F.struct("tree", "node")).alias("x"))
    return groups.where("n > 1").select("hash", "size", "n", "x.tree", "x.node")


def same_place(left: DataFrame, right: DataFrame) -> DataFrame:
    """(node, other): the topmost subtrees of hashed trees left that stand in right too, each with the first such place in right.

    Nodes below one that is found are not told again.
    """
    first = right.groupBy(F.col("hash").alias("_hash")).agg(F.min(F.struct(F.col("tree").alias("tree"), F.col("node").alias("node"))).alias("other"))
    matched = stored(left.join(first, F.col("hash") == F.col("_hash"), "left"))
    inside = matched.where("other is not null").select(F.col("tree").alias("_tree"), F.col("node").alias("_node"))
    below = matched.where("other is not null").join(inside, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("parent") == F.col("_node")), "left_anti")
    return below.select("tree", "node", F.col("other.tree").alias("other_tree"), F.col("other.node").alias("other_node"))


def without_bodies(lines: DataFrame, key: str, order: str, text: str, kept: DataFrame | None = None) -> DataFrame:
    """(key, order, text) of the lines of C-like texts without the bodies between outermost braces; a body becomes `;`.

    kept(key, name): names whose bodies stay where the line that opens one holds the name before a bracket. A body opens with the line's
    first brace at depth 0 and ends with the line that closes it; braces in strings or comments count like others.
    """
    count = lambda mark: F.length(text) - F.length(F.replace(F.col(text), F.lit(mark), F.lit("")))
    opened, closed = count("{"), count("}")
    rows = lines.select(key, order, text, opened.cast("long").alias("_open"), closed.cast("long").alias("_close"))
    deep = with_running(rows, key, [order], F.coalesce(F.col("_open") - F.col("_close"), F.lit(0).cast("long")), "_depth")
    before = F.col("_depth") - F.coalesce(F.col("_open") - F.col("_close"), F.lit(0).cast("long"))
    marked = deep.withColumn("_before", before)
    starts = (F.col("_before") == 0) & (F.col("_open") > 0)
    if kept is None:
        marked = marked.withColumn("_kept", F.lit(False))
    else:
        names = kept.select(F.col(key).alias("_key"), F.col("name").alias("_name")).groupBy("_key").agg(F.collect_set("_name").alias("_names"))  # a text's own few
        holds = F.exists("_names", lambda n: F.rlike(F.col(text), F.concat(F.lit(r"\b\Q"), n, F.lit(r"\E\s*\("))))
        marked = marked.join(names, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("_kept", F.coalesce(holds, F.lit(False)))
    marked = with_last_before(marked, key, [order], F.when(starts, F.col("_kept")), "_stays", own=True)
    inside = (F.col("_before") > 0) | starts
    head = F.concat(F.rtrim(F.substring_index(text, "{", 1)), F.lit(";"))
    shown = F.when(~inside | F.coalesce("_stays", F.lit(False)), F.col(text)).when(starts, head)
    return marked.select(key, order, shown.alias(text)).where(F.col(text).isNotNull())
