"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, secret scans and best-fit packing, in this order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs. Stages but the last return the columns of documents; n_chars follows the text. Extra columns are dropped at the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import marked, read, stored, text_or_empty, tokenizer_path
from quern.llm.line_dedup import line_dedup
from quern.llm.packing import pack
from quern.llm.quality import passing
from quern.llm.secret_scan import redacted, secret_scan
from quern.llm.simhash import near_texts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio, unchanged."""
    return passing(docs.select(COLUMNS), read(spark, sf_dir, "labels"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that later three-line windows cover."""
    return documents(line_dedup(docs.select(COLUMNS)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that chains of similarity 4/5 by five words join, the row with the smallest doc_id (null last) and hash."""
    name = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text_or_empty())))
    rows = docs.select(COLUMNS).withColumn("row", name)
    groups = near_texts(rows.select("row", text_or_empty().alias("text")))
    ids = stored(rows.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("n")))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    found = stored(ids.join(groups.distinct(), "row"))
    stay = found.groupBy("root").agg(F.min(order).alias("_first")).select("_first.row")
    gone = stored(found.join(stay, "row", "left_anti").select("row"))
    again = stored(found.where("n > 1").join(stay, "row", "left_semi").select("row"))
    named = gone.union(again)
    rows = marked(rows, named, "row")
    asked = rows.where("_marked")
    first = Window.partitionBy("row").orderBy(F.xxhash64("text", "lang", "source"), "text", "lang", "source")
    repeated = asked.join(again, "row", "left_semi").withColumn("_row", F.row_number().over(first)).where("_row = 1")
    others = rows.where("not _marked").select(COLUMNS).union(asked.join(named, "row", "left_anti").select(COLUMNS))
    return others.union(repeated.select(COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets redacted."""
    _, ledger = secret_scan(docs)
    spans = ledger.where(F.size("findings") > 0).select(F.col("blob").alias("_address"), "findings")
    texts = marked(docs.select(COLUMNS).withColumn("_address", F.unhex(F.sha2(text_or_empty(), 256))), spans, "_address")
    asked = texts.where("_marked").join(spans, "_address", "left")
    cut = asked.withColumn("text", F.when(F.col("findings").isNull(), F.col("text")).otherwise(redacted(F.col("text"), F.col("findings"))))
    return documents(texts.where("not _marked").select(COLUMNS).union(cut.select(COLUMNS)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("line dedup", repeated_lines), ("SimHash near-dedup", near_copies), ("secret scans", secrets), ("best-fit packing", packing)]

#: XXH64 with a seed, and byte-level tokens, are beyond SQL; tests/llm holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
