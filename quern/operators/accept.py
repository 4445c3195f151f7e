"""Which results of an ordered search are kept, as scans over (job, seq), without state.

Rows hold job, seq, score and hash, and equal hashes have equal scores; then the sequential rule equals these scans. Other columns
stay, whatever their names (best_before, and outcome of `labelled`, are replaced). Results with a null score or hash are not accepted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.ranges import with_running


def static_rule(results: DataFrame, base: int, better_only: bool = False, threshold: int | None = None, base_hash: str | None = None) -> Column:
    """What can be said of a row alone: score, threshold, and a hash and a source (if there is such a column) other than the base's."""
    rule = (F.col("score") < base) if better_only else (F.col("score") <= base)
    if threshold is not None:
        rule &= F.col("score") < threshold
    rule &= F.col("hash").isNotNull() if base_hash is None else F.col("hash") != base_hash
    return rule & F.col("source").isNotNull() if "source" in results.columns else rule


def first_rows(rows: DataFrame, *by: str, order: str = "seq") -> DataFrame:
    """rows that have the least order among those with equal `by` (nulls are equal); of several with it, all.

    The minimum is aggregated before the shuffle and joined back by group and order, so a group of many rows isn't one task's.
    """
    least = rows.groupBy(*(F.col(b).alias(f"_by{k}") for k, b in enumerate(by))).agg(F.min(order).alias("_least"))
    same = F.col(order).eqNullSafe(F.col("_least"))
    for k, b in enumerate(by):
        same &= F.col(b).eqNullSafe(F.col(f"_by{k}"))
    return rows.join(least, same, "left_semi")


def with_best_before(rows: DataFrame, base: int, name: str = "best_before") -> DataFrame:
    """rows with the best score of the job before each of them, at most base: minima of ranges of seq, carried on, then each range alone."""
    best = with_running(rows, "job", ["seq"], F.col("score"), name, F.min, own=False)
    return best.withColumn(name, F.least(F.lit(base).cast("long"), F.col(name)))


def accepted(results: DataFrame, base: int, better_only: bool = False, best_only: bool = False, threshold: int | None = None, base_hash: str | None = None) -> DataFrame:
    """The accepted rows with best_before, the best score before them. A score of 0 is accepted however often it comes; the
    base's own hash counts as seen. Rows with a null job are a job; seq must tell the rows of a job apart."""
    rows = results.where(static_rule(results, base, better_only, threshold, base_hash))
    rows = with_best_before(rows, base)
    if best_only:
        keep = rows.where("score <= best_before")
    else:
        keep = rows
    first = first_rows(rows.where("score <> 0").select("job", "hash", "seq"), "job", "hash")
    # A hash that was seen in a row that best_only drops counts as seen.
    firsts = first.select(F.col("job").alias("_job"), F.col("hash").alias("_hash"), F.col("seq").alias("_seq"))
    new = F.col("job").eqNullSafe(F.col("_job")) & (F.col("hash") == F.col("_hash")) & F.col("seq").eqNullSafe(F.col("_seq"))
    return keep.where("score = 0").union(keep.where("score <> 0").join(firsts, new, "left_semi"))


def first_by_source(results: DataFrame) -> DataFrame:
    """Rows whose source was not seen before in the job: a repeated source is never given out again."""
    return first_rows(results, "job", "source")


def labelled(results: DataFrame, base: int) -> DataFrame:
    """Every row with its outcome against the best of the rows before."""
    best, score = F.col("_best"), F.col("score")
    outcome = F.when(score < best, "new best").when(score == best, "tied").when(score < base, "better").when(score == base, "same score").otherwise("worse")
    return with_best_before(results, base, "_best").withColumn("outcome", outcome).drop("_best")
