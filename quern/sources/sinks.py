"""Tables that grow from run to run: results whose counters go on, and scores that are worked out once.

A table is a folder with one sub-folder a batch. A batch is written as a whole by Spark's committer; one that is written again, after a
failure say, replaces itself, as what it holds follows from the batches before it alone. So nothing is lost, doubled or skipped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from quern.operators.ranges import with_running
from quern.sources.tables import stored


def batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches below path, with their `batch`; none if nothing was written yet."""
    whole = f"{schema}, batch long"
    try:
        found = spark.read.option("basePath", path).schema(whole).parquet(f"{path}/batch=*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], whole)
    return found


def write_batch(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


RESULT = "job long, seq long, score long, source string, counter long, name string"


def numbered(results: DataFrame, written: DataFrame) -> DataFrame:
    """(job, seq, score, source, counter, name) of results(job, seq, score, source): counters by job and score go on from those written."""
    most = written.groupBy(F.col("job").alias("_job"), F.col("score").alias("_score")).agg(F.max("counter").alias("_most"))
    rows = results.select("job", "seq", "score", "source").withColumn("_place", F.struct("job", "score"))
    own = with_running(rows, "_place", ["seq"], F.lit(1).cast("long"), "_nth")
    joined = own.join(most, F.col("job").eqNullSafe(F.col("_job")) & F.col("score").eqNullSafe(F.col("_score")), "left")
    counter = F.col("_nth") + F.coalesce("_most", F.lit(0).cast("long"))
    name = F.concat(F.lit("output-"), F.col("score").cast("string"), F.lit("-"), counter.cast("string"))
    return joined.select("job", "seq", "score", "source", counter.alias("counter"), name.alias("name"))


def write_results(results: DataFrame, path: str, batch: int | None = None) -> DataFrame:
    """Adds results(job, seq, score, source) to the table at path as the next batch, or as `batch`, and returns the table.

    Each row is numbered inside its job and score by seq, from 1 on over all batches, and named output-<score>-<number>. Writing a
    batch again gives the same numbers, unless later batches were written since, which is an error. One writer at a time.
    """
    spark = results.sparkSession
    last = batches(spark, path, RESULT).agg(F.max("batch")).first()[0]
    batch = (-1 if last is None else last) + 1 if batch is None else batch
    if last is not None and batch < last:
        raise ValueError(f"batch {batch} comes before batch {last}, which is written")
    before = batches(spark, path, RESULT).where(F.col("batch") < batch)
    write_batch(stored(numbered(results, before)), path, batch)
    return batches(spark, path, RESULT)


def write_stream(results: DataFrame, path: str, state: str, delay: str | None = None) -> DataStreamWriter:
    """A stream of results into the table at path, at most once every `delay` (None: all that is there now, then it ends). Start it.

    Spark gives a batch that it is not sure about again, under its number, so it replaces itself; one before the last is done already.
    """

    def commit(rows: DataFrame, number: int) -> None:
        last = batches(rows.sparkSession, path, RESULT).agg(F.max("batch")).first()[0]
        if last is None or number >= last:
            write_results(rows, path, number)

    writer = results.writeStream.foreachBatch(commit).option("checkpointLocation", state)
    return writer.trigger(availableNow=True) if delay is None else writer.trigger(processingTime=delay)


MEMO = "digest string, score long, failed boolean"


def digest(source: Column) -> Column:
    return F.sha2(source, 256)


def scored_once(sources: DataFrame, path: str, score: Callable[[DataFrame], DataFrame], source: str = "source") -> DataFrame:
    """sources with score, worked out by score(sources(digest, source)) -> (digest, score) for those alone that no run before has scored.

    Equal sources are scored once and stored by digest in the table at path, which only grows; those that score gives no row or null
    for have failed, which is stored too. A null source has no score. A column score of the table is replaced.
    """
    spark = sources.sparkSession
    rows = sources.drop("score").withColumn("_digest", digest(F.col(source)))
    known = batches(spark, path, MEMO)
    last = known.agg(F.max("batch")).first()[0]
    new = rows.where(F.col("_digest").isNotNull()).groupBy(F.col("_digest").alias("digest")).agg(F.any_value(source).alias("source"))
    new = stored(new.join(known.select("digest"), "digest", "left_anti"))
    if not new.isEmpty():
        found = score(new).groupBy("digest").agg(F.min("score").alias("score"))
        kept = new.select("digest").join(found, "digest", "left").select("digest", F.col("score").cast("long").alias("score"), F.col("score").isNull().alias("failed"))
        write_batch(kept, path, (-1 if last is None else last) + 1)
    memo = batches(spark, path, MEMO).select(F.col("digest").alias("_d"), "score")
    return rows.join(memo, rows["_digest"] == memo["_d"], "left").drop("_digest", "_d")
