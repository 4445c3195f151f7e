"""Exact top-k inner products by columnar branch and bound.

Vectors are dealt to blocks of a bounded size, stored vertically (a row for each dimension). Each pair of a query block
and a row block is one small task group. Inside it a query walks through blocks of dimensions, those where it has most of
its mass first, and adds up partial products of all rows that are still alive. After each block a row's best possible
score is its partial product plus (remaining mass of the query) x (remaining mass of the row), by Cauchy and Schwarz; rows
that can't reach the k-th best score known for the query are dropped and the survivors are compacted. Scores are exact
integers, in doubles up to 2^53 and in whole numbers of any size beyond. Each group gives k rows a query at most; a partial
top k by key then merges groups.

Defined cases: vectors that are null, or hold a null or non-finite component, take no part; shorter vectors are padded with
zeros; rows that share a vec_id count once, with the smallest vector; a score that 64 bits can't hold raises OverflowError; a query with fewer than k others gets as many rows; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import read, stored

K, SCALE, QUERY_EVERY = 5, 256, 50
#: Most rows and queries that one group holds, and dimensions between two looks at the bounds.
ROW_BLOCK, QUERY_BLOCK, DIMENSIONS = 8192, 8192, 8


def scaled(embedding: Column) -> Column:
    """The vector in whole steps of 1/SCALE as doubles; null where a component is null or not finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE).cast("double")))


def whole_numbers(x: np.ndarray) -> np.ndarray:
    return np.frompyfunc(int, 1, 1)(x)


def top_rows(queries: np.ndarray, own: np.ndarray, floors: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, large: bool = False) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of queries, with id own: (its index, ids, scores) of the k best of rows, best first, ties to smaller ids.

    Of rows that can't reach the query's floor, any may be left out. Where sums may pass 2^53 (large), doubles only prune, with
    a margin for their errors, and survivors are scored in whole numbers of any size.
    """
    order = np.argsort(ids, kind="stable")
    ids, vertical = ids[order], np.ascontiguousarray(rows[order].T)
    mass, found = vertical * vertical, []
    whole = mass.sum(0)
    longest = math.sqrt(whole.max(initial=0))
    exact = whole_numbers(vertical) if large else vertical
    for i, q in enumerate(queries):
        dims = np.argsort(-np.abs(q), kind="stable")
        blocks = [dims[a : a + DIMENSIONS] for a in range(0, len(dims), DIMENSIONS)]
        alive = np.flatnonzero(ids != own[i])
        part, rest = np.zeros(len(alive)), whole[alive]
        left, known = float(q @ q), float(floors[i])
        margin = 1e-12 * len(dims) * math.sqrt(left) * longest
        for block in blocks:
            part = part + q[block] @ vertical[np.ix_(block, alive)]
            rest = np.maximum(rest - mass[np.ix_(block, alive)].sum(0), 0)
            left = max(left - float(q[block] @ q[block]), 0.0)
            slack = np.sqrt(left * rest)
            if len(alive) > k:  # k rows surely reach what the k-th best of the lower bounds says
                known = max(known, np.partition(part - slack, len(part) - k)[len(part) - k])
            drop = part + slack < known - margin - 1e-6 * (1 + abs(known))  # no row that is not a number
            if drop.sum() > 0.2 * len(alive):
                alive, part, rest = alive[~drop], part[~drop], rest[~drop]
        score = whole_numbers(q) @ exact[:, alive] if large and len(alive) else part
        best = np.lexsort((alive, -score))[:k] if not large else np.array(sorted(range(len(alive)), key=lambda j: (-score[j], alive[j]))[:k], np.int64)
        if large and any(abs(x) >= 2**63 for x in score[best]):
            raise OverflowError(f"an inner product of vector {own[i]} is beyond 64 bits")
        found.append((i, ids[alive[best]], score[best]))
    return found


def search(group: pa.Table, k: int, large: bool) -> pa.Table:
    """query_id, vec_id and score of the k best rows (kind 0) of a group for each of its queries (kind 1)."""
    kind, ids, floors = (group[c].to_numpy() for c in ("kind", "vec_id", "floor"))
    lists = group["v"].combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    vectors = np.zeros((len(ids), max(lengths.max(initial=0), 1)))
    vectors[np.repeat(np.arange(len(ids)), lengths), np.concatenate([np.arange(n) for n in lengths]) if len(lengths) else []] = lists.values.to_numpy()[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
    asked = kind == 1
    with np.errstate(all="ignore"):
        out = top_rows(vectors[asked], ids[asked], floors[asked], vectors[~asked], ids[~asked], k, large)
    own = ids[asked]
    columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in ([np.full(len(f), own[i]) for i, f, _ in out], [f for _, f, _ in out], [s for *_, s in out])]
    return pa.table([pa.array(c.astype(np.int64)) for c in columns], ["query_id", "vec_id", "score"])


def exact_top_k(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score: the k best of rows(vec_id, v) for each of queries(vec_id, v).

    The first block of rows is searched before the others: its k-th best score of a query is a floor for all other blocks.
    """
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    n_rows, longest = rows.agg(F.count("*"), F.max(norm)).first()
    n_queries, large = queries.count(), (longest or 0.0) >= 2.0**53
    row_blocks, query_blocks = -(-n_rows // ROW_BLOCK) or 1, -(-n_queries // QUERY_BLOCK) or 1
    spread = -(-12 // (row_blocks * query_blocks))  # small inputs still use several tasks
    row_blocks *= spread

    def dealt(df: DataFrame, mine: str, blocks: int, its: str, others: range, kind: int) -> DataFrame:
        """df to its block, and once for each block of the other side."""
        block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias(mine)
        return df.select(F.lit(kind).alias("kind"), block, F.explode(F.sequence(F.lit(others[0]), F.lit(others[-1]))).alias(its), "vec_id", "v", "floor")

    own = rows.withColumn("floor", F.lit(float("-inf")))

    def best(asked: DataFrame, blocks: range) -> DataFrame:
        left = dealt(own, "r", row_blocks, "q", range(query_blocks), 0).where(F.col("r").between(blocks[0], blocks[-1]))
        right = dealt(asked, "q", query_blocks, "r", blocks, 1)
        return left.unionByName(right).groupBy("r", "q").applyInArrow(lambda group: search(group, k, large), "query_id long, vec_id long, score long")

    found = best(queries.withColumn("floor", F.lit(float("-inf"))), range(1))
    if row_blocks > 1:
        found = stored(found)
        floors = found.groupBy(F.col("query_id").alias("_id")).agg(F.when(F.count("*") == k, F.min("score")).cast("double").alias("floor"))
        asked = queries.join(floors, queries["vec_id"] == floors["_id"], "left").select("vec_id", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
        found = found.union(best(asked, range(1, row_blocks)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def vectors(table: DataFrame) -> DataFrame:
    """vec_id and v of the rows of embeddings that take part."""
    return table.select("vec_id", scaled(F.col("embedding")).alias("v")).where("vec_id is not null and v is not null").groupBy("vec_id").agg(F.min("v").alias("v"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(vectors(read(spark, sf_dir, "embeddings")))
    return exact_top_k(rows, rows.where(F.col("vec_id") % QUERY_EVERY == 0))


QUERIES = {"op7_exact_top_k": op7_exact_top_k}
ORACLE_SQL = {
    "op7_exact_top_k": f"""with q as (select vec_id, list_transform(embedding, lambda x: floor({SCALE} * cast(x as double))) as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (select a.vec_id as query_id, b.vec_id, cast(list_inner_product(a.v, b.v) as bigint) as score from q a join q b on a.vec_id <> b.vec_id where a.vec_id % {QUERY_EVERY} = 0),
    r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
    select query_id, rank, vec_id, score from r where rank <= {K}"""
}
