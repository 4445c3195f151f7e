"""Helpers that several operators share."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries that one Python worker keeps of a word cache, and their greatest length in characters; others are computed each time.
CACHE_ENTRIES, CACHE_LENGTH = 800_000, 32
#: Bits a name of a bit map, one of which is set, and bits of one of its rows (those of bitmap_construct_agg).
NAME_BITS, MAP_BITS = 16, 32768


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a new local one only where none is set and the master is local."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quern-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder, so that nothing above it runs twice or again after a loss."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: for tables that several jobs read by column."""
    at = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a stored table, which nothing may read again."""
    spark = df.sparkSession
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def marked(rows: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """rows with _marked: true where names, a stored table, has their name, and for about one in NAME_BITS of the others.

    Rows that aren't marked surely have no partner, so only marked ones need go through the exchange of an exact join. A bit map
    is broadcast for that, of NAME_BITS for each of names.
    """
    bits = MAP_BITS * max(1, math.ceil(NAME_BITS * names.count() / MAP_BITS))
    bit = F.pmod(F.xxhash64(name), F.lit(bits))
    maps = names.select(bit.alias("_bit")).groupBy(F.expr(f"_bit div {MAP_BITS}").alias("_map")).agg(F.bitmap_construct_agg(F.col("_bit") % MAP_BITS).alias("_bits"))
    found = rows.withColumn("_bit", bit).join(F.broadcast(maps), F.expr(f"_bit div {MAP_BITS}") == F.col("_map"), "left")
    byte = F.conv(F.hex(F.expr(f"substring(_bits, cast(_bit % {MAP_BITS} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    is_set = F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1
    return found.withColumn("_marked", F.coalesce(is_set, F.lit(False))).drop("_bit", "_map", "_bits")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
