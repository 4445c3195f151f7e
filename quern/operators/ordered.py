"""Operators over rows in an order inside a key: as-of lookups, islands, near pairs, carried values, prefix sums.

All scan in two levels (see `ranges`, also for nulls and ties), so that a key may hold any share of the rows. A column of the result's
name is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import listing
from quern.operators.ranges import LAST, Ranges, kept_last, with_first_behind, with_last_before, with_running


def as_of(df: DataFrame, key: str, order: str, value: Column, name: str, forward: bool = False, own: bool = False) -> DataFrame:
    """df with the nearest non-null value before (or after) each row of its key; with `own` the row's own value counts too."""
    near = with_first_behind if forward else with_last_before
    return near(df, key, [order], value, name, own)


def carried(df: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    """df with the last non-null value up to each row."""
    return with_last_before(df, key, [order], value, name, own=True)


def runs(df: DataFrame, key: str, order: str, value: str, least: int) -> DataFrame:
    """(key, value, first, length) of maximal runs of equal values (nulls are equal) that have `least` rows or more."""
    r = Ranges(df.select(key, order, value), key, [order])
    own = F.struct(value)  # so that nulls are values
    r.carry(_r_before=(F.max_by(own, r.place()), kept_last))
    before = F.coalesce(F.lag(own).over(Window.partitionBy("_r_part", "_r_key").orderBy(*r.order)), "_r_before")
    r.rows = r.rows.withColumn("_r_start", F.when(before.isNull() | ~own.eqNullSafe(before), r.place()))
    r.carry(_r_carry=(F.max("_r_start"), kept_last))
    start = F.coalesce(F.last("_r_start", ignorenulls=True).over(r.inside()), "_r_carry").alias("_r_run")
    islands = r.rows.select(key, order, value, start)
    return islands.groupBy(key, "_r_run", value).agg(F.min(order).alias("first"), F.count("*").alias("length")).where(F.col("length") >= least).drop("_r_run")


def pairs_within(df: DataFrame, key: str, order: str, value: str, distance: int) -> DataFrame:
    """(key, a, b): rows at most `distance` apart with equal values, by looking ahead instead of joining; null values pair with none."""
    r = Ranges(df.select(key, F.col(order).alias("_r_order"), F.col(value).alias("_r_value")), key, ["_r_order"])
    # The first rows of a part are what the part before looks ahead to; they are `distance` a part and key at most.
    ahead = Window.partitionBy("_r_part", "_r_key").orderBy(*r.order)
    heads = r.rows.withColumn("_r_nth", F.row_number().over(ahead)).where(F.col("_r_nth") <= distance)
    later = heads.groupBy("_r_key", "_r_part").agg(F.array_sort(F.collect_list(F.struct("_r_nth", F.col("_r_order").alias("b"), F.col("_r_value").alias("v")))).alias("_r_heads"))
    behind = Window.partitionBy("_r_key").orderBy("_r_part").rowsBetween(1, distance)
    edge = later.select(F.col("_r_key").alias("_r_k"), F.col("_r_part").alias("_r_p"), F.slice(F.flatten(F.collect_list("_r_heads").over(behind)), 1, distance).alias("_r_next")).where(F.size("_r_next") > 0)
    rows = r.rows.join(F.broadcast(edge), (F.col("_r_part") == F.col("_r_p")) & F.col("_r_key").eqNullSafe(F.col("_r_k")), "left")  # one row a part at most
    left = F.count("*").over(r.inside(1, LAST))
    own = F.array(*(F.struct(F.lead("_r_order", k).over(ahead).alias("b"), F.lead("_r_value", k).over(ahead).alias("v")) for k in range(1, distance + 1)))
    beyond = F.transform(F.coalesce("_r_next", F.array().cast(edge.schema["_r_next"].dataType)), lambda x: F.struct(x["b"].alias("b"), x["v"].alias("v")))
    looked = rows.select(key, F.col("_r_order").alias("a"), "_r_value", F.concat(F.slice(own, F.lit(1), F.least(left, F.lit(distance)).cast("int")), F.slice(beyond, F.lit(1), F.greatest(F.lit(distance) - left, F.lit(0)).cast("int"))).alias("_r_ahead"))
    return looked.select(key, "a", "_r_value", F.explode("_r_ahead").alias("x")).where("x.v = _r_value").select(key, "a", "x.b")


def without_tail(df: DataFrame, key: str, order: str, is_filler: Column) -> DataFrame:
    """df without the rows at the end of each key that are filler only. A null of is_filler counts as no filler."""
    marked = with_first_behind(df, key, [order], F.when(F.coalesce(is_filler, F.lit(False)), None).otherwise(1), "_r_solid", own=True)
    return marked.where(F.col("_r_solid").isNotNull()).drop("_r_solid")


def neighbour(df: DataFrame, key: str, order: str | list[str], value: Column, name: str, forward: bool = False) -> DataFrame:
    """df with the value of the row before (or after) each row of its key, be it null; null where there is no such row."""
    near = with_first_behind if forward else with_last_before
    return near(df, key, [order] if isinstance(order, str) else order, F.struct(value.alias("v")), name).withColumn(name, F.col(name)["v"])


def turns(df: DataFrame, key: str, order: str) -> DataFrame:
    """df with turn, the number of each row inside its key from 1."""
    return with_running(df, key, [order], F.lit(1).cast("long"), "turn")


def round_robin(df: DataFrame, key: str, order: str) -> DataFrame:
    """df with turn and position: first rows of all keys, then second ones, each turn by key. Both numbers come from scans by parts, so
    neither a large key nor a turn of many keys is one task's."""
    return with_running(turns(df, key, order), None, ["turn", key], F.lit(1).cast("long"), "position")


def prefix_sums(df: DataFrame, order: str, value: str, width: int | None = None) -> DataFrame:
    """df with cum, the sum of value up to each row by order; with width, summed by ranges of about so many rows."""
    return with_running(df, None, [order], F.col(value), "cum", width=width)


def weighted_picks(df: DataFrame, order: str, weight: str, picks: DataFrame, width: int | None = None) -> DataFrame:
    """For each of picks(pick, u), u in [0, sum of weights): the first row whose running sum exceeds u.

    Rows and picks are sorted together by sum and u; the row is the next one behind the pick.
    """
    summed = prefix_sums(df, order, weight, width).where(F.col(weight) > 0)
    kind = summed.schema["cum"].dataType
    rows = summed.select(F.col("cum").alias("_at"), F.lit(0).alias("_pick"), F.lit(None).cast(picks.schema["pick"].dataType).alias("pick"), F.col(order).alias("_order"))
    asked = picks.select(F.col("u").cast(kind).alias("_at"), F.lit(1).alias("_pick"), "pick", F.lit(None).cast(summed.schema[order].dataType).alias("_order"))
    found = with_first_behind(rows.union(asked), None, ["_at", "_pick"], F.col("_order"), "_next")
    return found.where(F.col("_pick") == 1).where(F.col("_next").isNotNull()).select("pick", F.col("_at").cast(picks.schema["u"].dataType).alias("u"), F.col("_next").alias(order))


def with_relocations(df: DataFrame, key: str, order: str, row: str, arch: str, mark: str) -> DataFrame:
    """(key, order, row, has_symbol): rows that hold `mark` rewrite the row before them that doesn't, in order; those before any are dropped."""
    is_note = F.contains(F.col(row), F.lit(mark))
    headed = with_running(df, key, [order], F.when(is_note, 0).otherwise(1), "_head")
    grouped = headed.where("_head > 0").groupBy(key, "_head").agg(F.min(order).alias(order), F.max(F.when(~is_note, F.col(row))).alias(row), F.array_sort(F.collect_list(F.when(is_note, F.struct(F.col(order).alias("at"), F.col(row).alias("note"))))).alias("_notes"))
    written = F.aggregate("_notes", F.col(row), lambda line, x: listing.relocated(line, x["note"], arch))
    return grouped.select(key, order, written.alias(row), (F.size("_notes") > 0).alias("has_symbol"))


def small_data_rows(df: DataFrame, key: str, order: str, operation: str, operands: str, row: str) -> DataFrame:
    """df with operation and operands in the one form of small-data addresses where the next row of the key is such a relocation."""
    ahead = neighbour(df, key, order, F.col(row), "_next", forward=True)
    form = listing.small_data_form(F.col(operation), F.col(operands), F.col("_next"))
    return ahead.withColumn("_form", form).withColumn(operation, F.col("_form.operation")).withColumn(operands, F.col("_form.operands")).drop("_next", "_form")


def regions(df: DataFrame, key: str, order: str, starts: Column, ends: Column) -> DataFrame:
    """(key, first, last) of the regions of each key: from behind a row that starts one to before the row that ends it.

    A start in a region, an end without a start and a start without an end are errors. A region without rows has last below first,
    both null. Rows that start and end at once are no marks.
    """
    step = F.when(starts & ~F.coalesce(ends, F.lit(False)), 1).when(ends & ~F.coalesce(starts, F.lit(False)), -1).otherwise(0)
    deep = with_running(df.select(key, order, step.cast("long").alias("_step")), key, [order], F.col("_step"), "_depth")
    numbered = with_running(deep, key, [order], F.when(F.col("_step") == 1, 1).otherwise(0).cast("long"), "_region")
    wrong = (F.col("_depth") < 0) | (F.col("_depth") > 1)
    summed = numbered.groupBy(key, "_region").agg(
        F.min(F.when((F.col("_step") == 0) & (F.col("_depth") == 1), F.col(order))).alias("first"), F.max(F.when((F.col("_step") == 0) & (F.col("_depth") == 1), F.col(order))).alias("last"),
        F.bool_or(wrong).alias("_wrong"), F.sum("_step").alias("_left"),
    )
    checked = F.when(F.col("_wrong") | (F.col("_left") != 0), F.raise_error("regions don't match").cast("boolean")).otherwise(F.col("_region") > 0)
    return summed.where(checked).select(key, "first", "last")


def chosen_region(df: DataFrame, key: str, order: str, starts: Column, ends: Column, salt: str) -> DataFrame:
    """df's rows (but marks) of one region of each key, by the least hash of key, first row and salt; all rows of keys without regions."""
    found = regions(df, key, order, starts, ends)
    drawn = F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.col("first").cast("string"), F.lit(salt)), 256)
    one = found.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct("first", "last"), drawn).alias("_at"), F.count("*").alias("_n"))
    marks = F.coalesce(starts, F.lit(False)) != F.coalesce(ends, F.lit(False))
    joined = df.where(~marks).join(one, F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.where(F.col("_n").isNull() | F.col(order).between(F.col("_at.first"), F.col("_at.last"))).select(*df.columns)
