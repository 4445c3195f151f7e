"""Readers: the driver's tables, document lines, job folders and object-file headers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a stream of its files, be it a folder or one file (which a stream can only name by its folder)."""
    whole = table(spark, sf_dir, name)
    reader = spark.readStream.schema(whole.schema)
    if any(f.endswith(f"/{name}.parquet") for f in whole.inputFiles()):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, also set as checkpoint folder; a new local one only where the master is local."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quern-"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: for tables that several jobs read."""
    at = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no from 0, line); a null text is one empty line."""
    parts = F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("line_no", "line")
    return docs.select(key, parts)


def job_folders(spark: SparkSession, path: str, required: tuple[str, ...] = ("base.c", "target.o", "compile.sh")) -> DataFrame:
    """(folder, missing): which required files each folder under path lacks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", r"^(.*)/([^/]+)$", 1).alias("folder"), F.regexp_extract("path", r"^(.*)/([^/]+)$", 2).alias("name"))
    have = files.groupBy("folder").agg(F.collect_set(F.when(F.col("name").isin(*required), F.col("name"))).alias("have"))
    return have.select("folder", F.array_except(F.array(*map(F.lit, required)), "have").alias("missing"))


#: Machine numbers of an ELF header.
MACHINES = {3: "x86", 8: "mips", 20: "ppc", 40: "arm32"}


def elf_machine(content: Column) -> Column:
    """The architecture that an ELF header names, for either byte order; null for others."""
    digits = F.hex(F.substring(content, 1, 20))
    order = F.substring(digits, 11, 2)
    low, high = F.substring(digits, 37, 2), F.substring(digits, 39, 2)
    number = F.conv(F.when(order == "02", F.concat(low, high)).otherwise(F.concat(high, low)), 16, 10).cast("int")
    found = F.lit(None).cast("string")
    for k, name in MACHINES.items():
        found = F.when(number == k, name).otherwise(found)
    return F.when(F.substring(digits, 1, 8) == "7F454C46", found)


def settings(path: str) -> dict:
    """A TOML settings file; a missing one is empty."""
    import tomllib

    try:
        with open(path, "rb") as f:
            return tomllib.load(f)
    except FileNotFoundError:
        return {}


def weight_rows(spark: SparkSession, path: str, *sections: str) -> DataFrame:
    """(layer, name, weight) of a TOML file of weights: layer k is the k-th section named; a section that is missing has no rows."""
    found = settings(path)
    rows = [(k, name, float(w)) for k, s in enumerate(sections) for name, w in found.get(s, {}).items()]
    return spark.createDataFrame(rows, "layer int, name string, weight double")
