"""Scores of line sequences against a target: bags, fields and alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import listing
from quern.operators import alignment
from quern.sources.tables import lines

#: Penalties of a candidate's differences, and the score of one that could not be evaluated.
PENALTY = {"stack": 1, "branch": 1, "register": 5, "reorder": 60, "insert": 100, "delete": 100}
FAILED = 10**9


def penalty(**counts: Column) -> Column:
    return sum((PENALTY[k] * v for k, v in counts.items()), F.lit(0))


def bag_scores(docs: DataFrame, target: DataFrame) -> DataFrame:
    """For each document: lines that both bags hold (reorderings), lines too many and too few, and their score.

    Documents are counted by (doc_id, line); only the target's distinct lines are joined to them.
    """
    own = lines(docs).groupBy("doc_id", "line").agg(F.count("*").alias("n"))
    aim = lines(target).groupBy(F.col("line").alias("aim")).agg(F.count("*").alias("m"))
    total = lines(target).agg(F.count("*").alias("total"))
    common = F.when(F.col("m").isNull(), 0).otherwise(F.least("n", "m"))  # least() skips nulls
    counted = own.join(aim, own.line == aim.aim, "left").groupBy("doc_id").agg(F.sum(common).alias("reorderings"), (F.sum("n") - F.sum(common)).alias("insertions"))
    counted = counted.withColumn("deletions", F.lit(total.first()["total"]) - F.col("reorderings"))
    return counted.withColumn("score", penalty(reorder=F.col("reorderings"), insert=F.col("insertions"), delete=F.col("deletions")))


def error_counts(results: DataFrame, key: str, internal: Column) -> DataFrame:
    """(key, iterations, errors, internal_errors, best): a score of FAILED or more counts as an error and never as best; so do internal errors."""
    failed = F.coalesce(F.col("score") >= FAILED, F.lit(False))
    inner = F.coalesce(internal, F.lit(False))
    return results.groupBy(key).agg(F.count("*").alias("iterations"), F.count_if(inner | failed).alias("errors"), F.count_if(inner).alias("internal_errors"), F.min(F.when(~inner & ~failed, F.col("score"))).alias("best"))


def field_mismatches(a: Column, b: Column) -> Column:
    """How many fields of two arrays differ, and by how much their lengths do."""
    both = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), both), F.slice(b, F.lit(1), both), lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1))
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + x) + F.abs(F.size(a) - F.size(b))


def named_lines(docs: DataFrame, blind: bool = False) -> DataFrame:
    """(doc_id, line_no, line, name, fields) of texts that aren't null: a line's name is its first word, or if blind the whole line,
    white space at its ends aside; its fields are what commas part in the rest."""
    line = listing.stripped(F.col("line"))
    rest = F.when(F.contains(line, F.lit(" ")), F.transform(F.split(F.expr("substring(_line, instr(_line, ' ') + 1)"), ",", -1), lambda x: listing.stripped(x))).otherwise(F.array().cast("array<string>"))
    rows = lines(docs.where("text is not null")).withColumn("_line", line)
    return rows.select("doc_id", "line_no", "line", (F.col("_line") if blind else F.substring_index("_line", " ", 1)).alias("name"), rest.alias("fields"))


def align_scores(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Score, field mismatches, insertions and deletions of every document's lines against those of target, one document; a null text has failed."""
    known = docs.where("text is not null")
    mismatches = {"mismatches": field_mismatches(F.col("new.fields"), F.col("old.fields"))}
    weights = PENALTY | {"mismatches": PENALTY["register"]}
    found = alignment.scores(named_lines(docs), named_lines(target).drop("doc_id"), "doc_id", "line_no", "name", "line", mismatches, weights, known)
    zero = F.lit(0).cast("long")
    failed = docs.where("text is null").select("doc_id", F.lit(FAILED).cast("long").alias("score"), zero.alias("mismatches"), zero.alias("insertions"), zero.alias("deletions"))
    return found.select(F.col("key").alias("doc_id"), "score", "mismatches", "insertions", "deletions").union(failed)


def opcodes(docs: DataFrame, target: DataFrame, blind: bool = False) -> DataFrame:
    """(doc_id, tag, i1, i2, j1, j2): the steps from each document's lines i1..i2 to the lines j1..j2 of target, one document.

    Lines are compared by their first words, or if blind, whole but for white space at their ends. A null text has no steps.
    """
    return alignment.steps(named_lines(docs, blind), named_lines(target, blind), "doc_id", "line_no", "name").withColumnRenamed("key", "doc_id")


def line_diff(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, sign, line_no): lines that only the document (+) or only the target (-) has, blind to white space at their ends."""
    _, more, less = alignment.sides(opcodes(docs, target, blind=True).withColumnRenamed("doc_id", "key"))
    signed = more.select("key", F.lit("+").alias("sign"), F.col("i").alias("line_no")).union(less.select("key", F.lit("-").alias("sign"), F.col("j").alias("line_no")))
    return signed.withColumnRenamed("key", "doc_id")


def distances(rows: DataFrame, first: object, key: str, order: str, name: str) -> DataFrame:
    """(key, distance): how many names must be put in, taken out or replaced to turn each sequence into that of the key `first`.

    Each distinct name has a character of its own, so names count as equal only if they are; more than 50,000 names are an error. A
    sequence is one value, as the functions that it stands for are. Null names are left out.
    """
    named = rows.where(F.col(name).isNotNull())
    numbers = named.select(name).distinct().agg(F.array_sort(F.collect_list(name)).alias("_names"))
    numbers = numbers.select(F.when(F.size("_names") <= 50_000, F.map_from_entries(F.transform("_names", lambda x, i: F.struct(x, i)))).otherwise(F.raise_error("more than 50,000 names")).alias("_of"))
    code = F.decode(F.unhex(F.lpad(F.hex(F.element_at("_of", F.col(name)) + 65), 4, "0")), "UTF-16BE")
    coded = named.join(F.broadcast(numbers)).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), code.alias("c")))), lambda x: x["c"]), "").alias("_own"))
    aim = coded.where(F.col(key) == first).select(F.col("_own").alias("_aim"))
    return coded.join(F.broadcast(aim)).select(key, F.levenshtein("_own", "_aim").cast("long").alias("distance"))


def listing_scores(rows: DataFrame, target: DataFrame, key: str, order: str, arch: str, stack: bool = True, branches: bool = True) -> DataFrame:
    """(key, stack, branch, register, reorderings, insertions, deletions, score) of listings against a target's, by all six penalties.

    Both have the columns order, row, name (the operation) and has_symbol. `stack` counts how far places on the stack are apart, `branches`
    counts branches that go elsewhere; otherwise rows should come in the normal form without them. Listings of equal operations are aligned once.
    """
    found = listing.differences(F.col("new"), F.col("old"), arch, stack, branches)
    scored = alignment.scores_by_kind(rows, target, key, order, "name", "row", found, PENALTY)
    return scored.withColumnRenamed("key", key)
