"""Alignment of sequences as relations: the longest common run first, then what lies left and right of it, in rounds.

Equal names of a sequence and its target make cells (i, j); cells in a row on a diagonal i - j make a run. In every round each open
segment takes its longest run (then the smallest i, then j) as a block and splits into the part before and the part behind it, and
the other runs are cut to the parts that they reach into. Segments without a run are gaps. All sequences go through the rounds
together, so there are as many rounds as the deepest splitting has levels, whatever the number of sequences; each round is
a grouping by segment and a join with it, which adaptive skew handling can split, and no task holds a whole sequence.

The cells are what this costs: a name that stands r times in a sequence and s times in its target makes r * s of them.

Defined cases: positions count from 0 without gaps; null names equal each other; a sequence without rows has no steps (against a
target without rows) or one, `insert`; repeated (key, position) rows are not allowed; columns that aren't named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.tables import stored

SEGMENT = ["key", "i1", "i2", "j1", "j2"]


def common_runs(rows: DataFrame, target: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """(key, a, b, n): maximal runs of n equal names from position a of a sequence and b of the target, which has the columns order, name."""
    own = rows.select(F.col(key).alias("key"), F.col(order).cast("long").alias("i"), F.col(name).alias("_name"))
    aim = target.select(F.col(order).cast("long").alias("j"), F.col(name).alias("_aim"))
    cells = own.join(aim, F.col("_name").eqNullSafe(F.col("_aim"))).select("key", "i", "j")
    diagonal = Window.partitionBy("key", F.col("i") - F.col("j")).orderBy("i")  # a task never holds more than one diagonal of one sequence
    islands = cells.withColumn("_run", F.col("i") - F.row_number().over(diagonal))
    return islands.groupBy("key", (F.col("i") - F.col("j")).alias("_d"), "_run").agg(F.min("i").alias("a"), F.min("j").alias("b"), F.count("*").alias("n")).drop("_d", "_run")


def steps(rows: DataFrame, target: DataFrame, key: str, order: str, name: str, keys: DataFrame | None = None) -> DataFrame:
    """(key, tag, i1, i2, j1, j2): how each sequence of rows turns into the target, by equal names; `keys` names sequences without rows too."""
    length = target.agg(F.count("*").alias("j2"))
    sizes = rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("i2"))
    if keys is not None:
        sizes = keys.select(F.col(key).alias("key")).distinct().join(sizes, "key", "left").select("key", F.coalesce("i2", F.lit(0)).alias("i2"))
    zero = F.lit(0).cast("long")
    roots = stored(sizes.join(F.broadcast(length)).select("key", zero.alias("i1"), "i2", zero.alias("j1"), "j2"))  # length is one row
    runs = stored(common_runs(rows, target, key, order, name).join(roots, "key").select(*SEGMENT, "a", "b", "n"))
    blocks = []
    while not runs.isEmpty():
        longest = F.max(F.struct(F.col("n"), (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))).alias("x")
        taken = runs.groupBy(*SEGMENT).agg(longest).select(*SEGMENT, (-F.col("x.a")).alias("at"), (-F.col("x.b")).alias("on"), F.col("x.n").alias("size"))
        before = F.struct("i1", F.col("at").alias("i2"), "j1", F.col("on").alias("j2"), F.lit(False).alias("block"))
        behind = F.struct((F.col("at") + F.col("size")).alias("i1"), "i2", (F.col("on") + F.col("size")).alias("j1"), "j2", F.lit(False).alias("block"))
        whole = F.struct("i1", "i2", "j1", "j2", F.lit(True).alias("block"))
        is_taken = (F.col("a") == F.col("at")) & (F.col("b") == F.col("on"))  # no two runs of a segment start at one cell
        cut = runs.join(taken, SEGMENT).select("key", "a", "b", "n", F.explode(F.when(is_taken, F.array(whole)).otherwise(F.array(before, behind))).alias("s"))
        skip = F.greatest(zero, F.col("s.i1") - F.col("a"), F.col("s.j1") - F.col("b"))
        left = F.least(F.col("n"), F.col("s.i2") - F.col("a"), F.col("s.j2") - F.col("b")) - skip
        found = stored(cut.where(left > 0).select("key", "s.*", (F.col("a") + skip).alias("a"), (F.col("b") + skip).alias("b"), left.alias("n")))
        blocks.append(found.where("block").select(*SEGMENT, F.col("a").alias("at"), F.col("b").alias("on"), F.col("n").alias("size")))
        runs = found.where("not block").select(*SEGMENT, "a", "b", "n")
    if not blocks:
        return _gaps(roots)
    found = blocks[0]
    for b in blocks[1:]:
        found = found.union(b)
    parts = F.array(F.struct("i1", F.col("at").alias("i2"), "j1", F.col("on").alias("j2")), F.struct((F.col("at") + F.col("size")).alias("i1"), "i2", (F.col("on") + F.col("size")).alias("j1"), "j2"))
    open_ = roots.union(found.select("key", F.explode(parts).alias("s")).select("key", "s.*"))
    equal = found.select("key", F.lit("equal").alias("tag"), F.col("at").alias("i1"), (F.col("at") + F.col("size")).alias("i2"), F.col("on").alias("j1"), (F.col("on") + F.col("size")).alias("j2"))
    return equal.union(_gaps(open_.join(found, SEGMENT, "left_anti")))


def _gaps(segments: DataFrame) -> DataFrame:
    tag = F.when(F.col("i1") == F.col("i2"), "insert").when(F.col("j1") == F.col("j2"), "delete").otherwise("replace")
    return segments.where("i1 < i2 or j1 < j2").select("key", tag.alias("tag"), "i1", "i2", "j1", "j2")


def sides(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of steps: (key, i, j) of lines that are set side by side, (key, i) of those that only the sequence has, (key, j) of those only the target has."""
    places = lambda a, b: F.explode(F.sequence(F.col(a), F.col(b) - 1))
    pairs = found.where("tag = 'equal'").select("key", places("i1", "i2").alias("i"), (F.col("j1") - F.col("i1")).alias("_d")).select("key", "i", (F.col("i") + F.col("_d")).alias("j"))
    rest = found.where("tag <> 'equal'")
    return pairs, rest.where("i1 < i2").select("key", places("i1", "i2").alias("i")), rest.where("j1 < j2").select("key", places("j1", "j2").alias("j"))


def scores(rows: DataFrame, target: DataFrame, key: str, order: str, name: str, line: str, differences: dict[str, Column], penalties: dict[str, int], keys: DataFrame | None = None) -> DataFrame:
    """(key, the counts named in differences, reorderings, insertions, deletions, score) of each sequence of rows against the target.

    `differences` are counts over the structs `new` (a row of the sequence) and `old` (the row of the target that the alignment sets beside it).
    Lines that only one side has count as bags: a line that both sides have too many of is a reordering. Penalties are by the names of
    the counts, and reorder, insert and delete.
    """
    rows, target = stored(rows), stored(target)
    found = stored(steps(rows, target, key, order, name, keys))
    pairs, _, less = sides(found)
    own = rows.select(F.col(key).alias("key"), F.col(order).cast("long").alias("i"), F.struct(*rows.columns).alias("new"))
    aim = target.select(F.col(order).cast("long").alias("j"), F.struct(*target.columns).alias("old"))
    placed = own.join(pairs, ["key", "i"], "left")  # a row that has no place in the target is one too many
    zero = F.lit(0).cast("long")
    none = [zero.alias(k) for k in differences]
    counted = placed.where("j is not null").join(aim, "j").select("key", *(v.cast("long").alias(k) for k, v in differences.items()), zero.alias("_n"), F.lit(None).cast("string").alias("_line"))
    added = placed.where("j is null").select("key", *none, F.lit(1).cast("long").alias("_n"), F.col("new").getField(line).alias("_line"))
    gone = less.join(aim, "j").select("key", *none, F.lit(-1).cast("long").alias("_n"), F.col("old").getField(line).alias("_line"))
    bags = counted.union(added).union(gone).groupBy("key", "_line").agg(*(F.sum(k).alias(k) for k in differences), F.count_if(F.col("_n") > 0).alias("_more"), F.count_if(F.col("_n") < 0).alias("_less"))
    both = F.least("_more", "_less")
    summed = bags.groupBy("key").agg(*(F.sum(k).alias(k) for k in differences), F.sum(both).alias("reorderings"), F.sum(F.col("_more") - both).alias("insertions"), F.sum(F.col("_less") - both).alias("deletions"))
    return _scored(keys if keys is not None else rows, summed, key, differences, penalties)


def _scored(keys: DataFrame, summed: DataFrame, key: str, differences: dict[str, Column], penalties: dict[str, int]) -> DataFrame:
    """summed, with zeros for keys that it lacks, and scores."""
    zero = F.lit(0).cast("long")
    whole = keys.select(F.col(key).alias("key")).distinct().join(summed, "key", "left")
    names = [*differences, "reorderings", "insertions", "deletions"]
    filled = whole.select("key", *(F.coalesce(n, zero).alias(n) for n in names))
    weights = [*(penalties[k] for k in differences), penalties["reorder"], penalties["insert"], penalties["delete"]]
    return filled.withColumn("score", sum((w * F.col(n) for w, n in zip(weights, names)), zero))


def with_kind(rows: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """rows with _kind: their number in the sequence and 128 bits of a hash of all its places and names. Costs no shuffle where rows come by key."""
    whole = Window.partitionBy(key)
    hashes = (F.bit_xor(F.xxhash64(F.lit(salt), F.col(order).cast("long"), F.col(name).isNull(), name)).over(whole) for salt in (1, 2))
    return rows.withColumn("_kind", F.struct(F.count("*").over(whole).alias("n"), *(h.alias(f"h{k}") for k, h in enumerate(hashes))))


def scores_by_kind(rows: DataFrame, target: DataFrame, key: str, order: str, name: str, line: str, differences: dict[str, Column], penalties: dict[str, int]) -> DataFrame:
    """`scores` of many sequences that have few different successions of names: of each kind one sequence is aligned, and its steps are joined
    to the rows of all. A row whose name differs from that of its kind (two successions with one hash) is an error.

    Lines that the target alone has are counted by kind; a row that has no place in the target is a reordering if its kind lacks such a line.
    """
    rows, target = stored(with_kind(rows, key, order, name)), stored(target)
    known, zero = rows.where(F.col(key).isNotNull()), F.lit(0).cast("long")
    kinds = stored(known.groupBy("_kind").agg(F.min(key).alias("_one")))
    ones = stored(known.join(kinds.select("_one"), F.col(key) == F.col("_one"), "left_semi").select(key, order, name))
    found = stored(steps(ones, target, key, order, name))
    pairs, _, less = sides(found)
    aim = target.select(F.col(order).cast("long").alias("j"), F.struct(*target.columns).alias("old"))
    gone = stored(less.join(aim, "j").groupBy(F.col("key").alias("_of"), F.col("old").getField(line).alias("_gone")).agg(F.count("*").alias("_m")))
    sizes = found.where("tag <> 'equal'").groupBy("key").agg(F.sum(F.col("i2") - F.col("i1")).alias("_more"), F.sum(F.col("j2") - F.col("j1")).alias("_less"))
    places = ones.select(F.col(key).alias("key"), F.col(order).cast("long").alias("i"), F.col(name).alias("_name")).join(pairs, ["key", "i"], "left").join(sizes, "key", "left")
    places = stored(places.select(F.col("key").alias("_one"), "i", "_name", "j", F.coalesce("_more", zero).alias("_more"), F.coalesce("_less", zero).alias("_less")))
    same = F.col("_name").eqNullSafe(F.col("new").getField(name))
    kind = F.when(same, F.col("key")).otherwise(F.raise_error("two successions of names have one hash").cast(rows.schema[key].dataType))
    own = known.select(F.col(key).alias("key"), F.col(order).cast("long").alias("i"), F.struct(*(c for c in rows.columns if c != "_kind")).alias("new"), "_kind")
    beside = own.join(kinds, "_kind").join(places, ["_one", "i"], "left").join(aim, "j", "left")
    lacking = F.when(F.col("j").isNull(), F.col("new").getField(line))
    counted = beside.select(kind.alias("key"), "_one", "_more", "_less", F.col("j").isNull().alias("_is_more"), lacking.alias("_line"), *(F.when(F.col("j").isNotNull(), v.cast("long")).otherwise(zero).alias(k) for k, v in differences.items()))
    met = counted.join(gone, F.col("_is_more") & (F.col("_one") == F.col("_of")) & F.col("_line").eqNullSafe(F.col("_gone")), "left")
    is_met = F.col("_m").isNotNull()
    bags = met.groupBy("key", F.when(is_met, F.col("_line")).alias("_line"), is_met.alias("_met")).agg(*(F.sum(k).alias(k) for k in differences), F.least(F.count("_m"), F.max("_m")).alias("_both"), F.max("_more").alias("_more"), F.max("_less").alias("_less"))
    summed = bags.groupBy("key").agg(*(F.sum(k).alias(k) for k in differences), F.sum(F.when(F.col("_met"), F.col("_both")).otherwise(0)).alias("reorderings"), F.max("_more").alias("_more"), F.max("_less").alias("_less"))
    summed = summed.select("key", *differences, "reorderings", (F.col("_more") - F.col("reorderings")).alias("insertions"), (F.col("_less") - F.col("reorderings")).alias("deletions"))
    return _scored(rows, summed, key, differences, penalties)
