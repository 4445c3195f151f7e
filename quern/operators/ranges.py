"""Scans along an order inside keys in two levels, so that no task holds a whole key.

Rows are sorted once by key and order over all tasks and stored; a sorted part holds a range of the order. A scan then works inside
each part, and what comes from the parts before (or behind) is carried: every part is summed up to a row for each of its keys, and as
parts are sorted by key, only a key that a part begins (or ends) with reaches over its edge. So at most one row a part is carried,
which is why the carry is broadcast.

Defined cases: null keys are a key; null orders come first; rows with equal key and order are put in the order of a hash of all their
columns, identical ones in any; an empty table gives an empty result. Helper columns start with _r_, and so mustn't the table's own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quern.sources.tables import stored

FIRST, LAST = Window.unboundedPreceding, Window.unboundedFollowing


class Ranges:
    def __init__(self, df: DataFrame, key: str | None, order: list[str], width: int | None = None):
        """df sorted by key (None: one key for all rows) and order. With width, parts have about so many rows; otherwise there is one a shuffle partition."""
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if width is None else -(-df.count() // width) or 1
        keyed = df.withColumn("_r_key", F.lit(0) if key is None else F.col(key)).withColumn("_r_tie", F.xxhash64(*df.columns))
        self.order = [*order, "_r_tie"]
        ranged = keyed.repartitionByRange(parts, "_r_key", *self.order).sortWithinPartitions("_r_key", *self.order)
        self.columns, self.rows = df.columns, stored(ranged.withColumn("_r_part", F.spark_partition_id()))

    def inside(self, start: int = FIRST, end: int = 0) -> WindowSpec:
        """The rows of the same key and part from start to end, in order."""
        return Window.partitionBy("_r_part", "_r_key").orderBy(*self.order).rowsBetween(start, end)

    def place(self) -> Column:
        """What sorts the rows of a part: the largest is the last row."""
        return F.struct(*self.order)

    def carry(self, forward: bool = False, **sums: tuple[Column, Callable[[Column], Column]]) -> Ranges:
        """Adds, for each name, fold(agg) over the key's parts before a row's own, or with `forward` behind it; null if there is none."""
        summed = self.rows.groupBy("_r_key", "_r_part").agg(*(agg.alias(name) for name, (agg, _) in sums.items()))
        # A key's parts are at most all parts: bounded whatever the number of rows.
        other = Window.partitionBy("_r_key").orderBy(F.desc("_r_part") if forward else "_r_part").rowsBetween(FIRST, -1)
        folded = summed.select(F.col("_r_key").alias("_r_k"), F.col("_r_part").alias("_r_p"), F.count("*").over(other).alias("_r_n"), *(fold(F.col(name)).over(other).alias(name) for name, (_, fold) in sums.items()))
        edge = folded.where("_r_n > 0").drop("_r_n")  # at most one row a part
        self.rows = self.rows.join(F.broadcast(edge), (F.col("_r_part") == F.col("_r_p")) & F.col("_r_key").eqNullSafe(F.col("_r_k")), "left").drop("_r_p", "_r_k")
        return self


def last_value(value: Column, place: Column) -> Column:
    """An aggregate: the last non-null value."""
    return F.max_by(value, F.when(value.isNotNull(), place))


def first_value(value: Column, place: Column) -> Column:
    return F.min_by(value, F.when(value.isNotNull(), place))


def kept_last(c: Column) -> Column:
    return F.last(c, ignorenulls=True)


def with_last_before(df: DataFrame, key: str | None, order: list[str], value: Column, name: str, own: bool = False) -> DataFrame:
    """df with the last non-null value before each row of its key, or with `own` up to it."""
    r = Ranges(df.withColumn("_r_value", value), key, order)
    r.columns = [c for c in df.columns if c != name]
    r.carry(_r_carry=(last_value(F.col("_r_value"), r.place()), kept_last))
    near = F.last("_r_value", ignorenulls=True).over(r.inside(FIRST, 0 if own else -1))
    return r.rows.select(*r.columns, F.coalesce(near, "_r_carry").alias(name))


def with_first_behind(df: DataFrame, key: str | None, order: list[str], value: Column, name: str, own: bool = False) -> DataFrame:
    """df with the first non-null value behind each row of its key, or with `own` from it on."""
    r = Ranges(df.withColumn("_r_value", value), key, order)
    r.columns = [c for c in df.columns if c != name]
    r.carry(forward=True, _r_carry=(first_value(F.col("_r_value"), r.place()), kept_last))
    near = F.first("_r_value", ignorenulls=True).over(r.inside(0 if own else 1, LAST))
    return r.rows.select(*r.columns, F.coalesce(near, "_r_carry").alias(name))


def with_running(df: DataFrame, key: str | None, order: list[str], value: Column, name: str, fold: Callable[[Column], Column] = F.sum, own: bool = True, width: int | None = None, none: Column | None = None) -> DataFrame:
    """df with fold (sum, min, max) of the values up to each row, or without `own` before it; `none` where there are no such values."""
    r = Ranges(df.withColumn("_r_value", value), key, order, width)
    r.columns = [c for c in df.columns if c != name]
    r.carry(_r_carry=(fold(F.col("_r_value")), fold))
    near = fold(F.col("_r_value")).over(r.inside(FIRST, 0 if own else -1))
    both = {F.min: F.least, F.max: F.greatest}.get(fold)
    whole = both(near, F.col("_r_carry")) if both else F.coalesce(near + F.col("_r_carry"), near, F.col("_r_carry"))
    return r.rows.select(*r.columns, (whole if none is None else F.coalesce(whole, none)).alias(name))
