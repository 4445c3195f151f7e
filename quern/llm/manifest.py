"""A Merkle manifest of a dataset: hash trees over the rows of each group, and one over the groups' roots.

Rows become leaves, in order inside their group; every `fanout` consecutive nodes become one, until one is left. Places come from one
range sort: each sorted partition counts its rows by group, the small table of these counts gives every partition its offset. Then
superblocks: nodes are bucketed by place // fanout**levels, a bucket collapses `levels` levels at once, its root is a node of the next
round. So a tree of n leaves takes log(n) / (levels * log(fanout)) rounds, and no task holds more than one bucket of fanout**levels
nodes, however large a group is. On the way down each bucket joins its rows' lower proofs with the upper proof of its root.

A proof is an array of steps from the leaf to the top. Each step is the text whose SHA-256 the parent is, with | in the place of the
node's own digest; so replacing | gives the parent (`folded`), and removing it leaves the siblings (`siblings`).

Defined cases: nulls hash as `-`; a null group is a group of its own and comes first; rows without a key come before all others;
rows with equal keys are leaves in the order of their hashes; repeated rows are a leaf each; an empty table gives an empty result; a
group of one row has its leaf as root and no steps of its own; columns that aren't named are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import partitions, read, stored

FANOUT, LEVELS = 2, 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows up to which a small table is broadcast; a larger one is joined by a shuffle.
SMALL = 100_000


def field(value: Column) -> Column:
    """What a value adds to its leaf's input: its byte count and itself, or - for null."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def siblings(steps: Column) -> Column:
    """The siblings' digests of a proof, from the leaf's to the top's, as one text."""
    return F.array_join(F.transform(steps, lambda s: F.replace(s, F.lit("|"), F.lit(""))), "")


def folded(start: Column, steps: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    return F.aggregate(steps, start, lambda h, s: F.sha2(F.replace(s, F.lit("|"), h), 256))


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast only if it is found to have at most SMALL rows."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with place (from 0, inside the group by the columns of order) and size (of the group), stored. `order` must tell rows apart."""
    n = partitions(rows.sparkSession)
    sorted_rows = rows.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order)
    numbered = stored(sorted_rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    counts = numbered.groupBy(group, "_part").agg(F.min("_at").alias("_least"), F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most a row a partition
    whole = Window.partitionBy(group)
    starts = stored(counts.select(group, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_least")).alias("_shift"), F.sum("_n").over(whole).alias("size")))
    joined = numbered.join(small(starts), [group, "_part"])
    return stored(joined.withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift"))


def parents(nodes: list[str], fanout: int) -> list[str]:
    return [hashlib.sha256("".join(nodes[i : i + fanout]).encode()).hexdigest() for i in range(0, len(nodes), fanout)]


def height(size: int, fanout: int) -> int:
    """Levels above the leaves of a tree of `size` leaves."""
    n = 0
    while size > 1:
        size, n = -(-size // fanout), n + 1
    return n


def collapsed(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The roots of all buckets of nodes(tree, place, size, digest), as nodes of the next round, stored."""
    width = fanout**levels

    def root(bucket: pd.DataFrame) -> pd.DataFrame:
        size, place = int(bucket["size"].iloc[0]), int(bucket["place"].iloc[0])
        level = bucket.sort_values("place")["digest"].tolist()
        for _ in range(min(levels, height(size, fanout))):
            level = parents(level, fanout)
        return pd.DataFrame({"tree": bucket["tree"].iloc[:1], "place": [place // width], "size": [-(-size // width)], "digest": level})

    return stored(nodes.select("tree", "place", "size", "digest").groupBy("tree", F.expr(f"place div {width}")).applyInPandas(root, "tree string, place long, size long, digest string"))


def with_proofs(nodes: DataFrame, above: DataFrame, fanout: int, levels: int, own: list[str]) -> DataFrame:
    """nodes(tree, place, size, digest, own...) with root and steps of above(tree, place, root, steps), whose places are buckets of nodes."""
    width = fanout**levels
    kinds = {c: nodes.schema[c].dataType.simpleString() for c in own}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("place")
        level, up = left["digest"].to_pylist(), right["steps"][0].as_py()
        steps = [[] for _ in level]
        for k in range(min(levels, height(left["size"][0].as_py(), fanout))):
            runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
            marked = ["".join(r[:j]) + "|" + "".join(r[j + 1 :]) for r in runs for j in range(len(r))]
            for i, s in enumerate(steps):
                s.append(marked[i // fanout**k])
            level = parents(level, fanout)
        columns = [left[c] for c in ("tree", "place", "digest", *own)]
        rooted = pa.array(right["root"].to_pylist() * len(left), pa.string())
        return pa.table([*columns, rooted, pa.array([s + up for s in steps], pa.list_(pa.string()))], ["tree", "place", "digest", *own, "root", "steps"])

    schema = "tree string, place long, digest string, " + "".join(f"`{c}` {k}, " for c, k in kinds.items()) + "root string, steps array<string>"
    buckets = nodes.select("tree", "place", "size", "digest", *own).withColumn("_bucket", F.expr(f"place div {width}")).groupBy("tree", "_bucket")
    return buckets.cogroup(above.select("tree", F.col("place").alias("_bucket"), "root", "steps").groupBy("tree", "_bucket")).applyInArrow(run, schema)


def trees(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """nodes and the roots of their buckets, round by round, up to one node a tree."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("size")).first()[0] or 0) > 1:
        rounds.append(collapsed(rounds[-1], fanout, levels))
    return rounds


def manifest(leaves: DataFrame, key: str, group: str, digest: str, carried: tuple[str, ...] = (), fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """key, group, leaf, subroot, root, steps and the carried columns for each row of leaves, whose digests are lowercase hex."""
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    own = [f"_c{k}" for k in range(len(carried))]
    kept = [F.col(c).alias(n) for c, n in zip(carried, own)]
    rows = leaves.select(tree.alias("tree"), F.col(key).alias("_key"), F.col(group).alias("_group"), F.col(digest).alias("digest"), *kept)
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()))
    below = trees(ranked(rows, "tree", ["_key", "digest", "_row"]), fanout, levels)
    tops = ranked(below[-1].select(F.lit("").alias("tree"), F.col("tree").alias("_tree"), F.col("digest").alias("digest")), "tree", ["_tree"])
    upper = trees(tops, fanout, levels)
    above = upper[-1].select("tree", "place", F.col("digest").alias("root"), F.array().cast("array<string>").alias("steps"))
    for nodes in upper[-2::-1]:
        above = with_proofs(nodes, above, fanout, levels, ["_tree"] if nodes is tops else [])
    if upper[-1] is tops:  # one tree or none: its root is the root of all
        above = above.join(tops.select("_tree", "tree"), "tree")
        above = above.withColumn("subroot", F.col("root"))
    else:
        above = above.withColumn("subroot", F.col("digest"))
    above = stored(above.select(F.col("_tree").alias("tree"), F.lit(0).cast("long").alias("place"), F.concat("subroot", F.lit(":"), "root").alias("root"), "steps"))
    for nodes in below[-2::-1]:
        above = with_proofs(nodes, above, fanout, levels, ["_key", "_group", *own] if nodes is below[0] else [])
    if len(below) == 1:  # every tree is one leaf
        above = below[0].join(above.select("tree", "root", "steps"), "tree")
    parts = F.split("root", ":")
    return above.select(F.col("_key").alias(key), F.col("_group").alias(group), F.col("digest").alias("leaf"), parts[0].alias("subroot"), parts[1].alias("root"), "steps", *(F.col(n).alias(c) for c, n in zip(carried, own)))


def document_leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf, and changed: the leaf after tampering, where 7 divides the crc32 of the doc_id and n_chars is no null."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = [F.col(c).cast("decimal(20,0)") + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    return docs.select("doc_id", "lang", leaf(*map(F.col, FIELDS)).alias("leaf"), F.when(tampered & F.col("n_chars").isNotNull(), leaf(*more)).alias("changed"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = manifest(document_leaves(read(spark, sf_dir, "documents")), "doc_id", "lang", "leaf", ("changed",))
    found = made.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("steps")), 256).alias("proof_sha256"), folded(F.coalesce("changed", "leaf"), F.col("steps")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field_sql(value: str) -> str:
    return f"coalesce(strlen(cast({value} as varchar)) || ':' || cast({value} as varchar), '-')"


MANIFEST_SQL = f"""with recursive steps as (select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, cast(i as bigint)) order by i) as steps from range(256) r(i)),
doc as (select *, coalesce('=' || lang, '') as tree, sha256({" || ".join(map(_field_sql, FIELDS))}) as leaf, sha256({" || ".join(_field_sql("cast(n_chars as hugeint) + 1" if c == "n_chars" else c) for c in FIELDS)}) as more,
    xor(list_reduce(range(strlen(cast(doc_id as varchar))), lambda c, k: xor(c >> 8, steps[(xor(c, unicode(substr(cast(doc_id as varchar), cast(k + 1 as integer), 1))) & 255) + 1]), cast(4294967295 as bigint)), 4294967295) % 7 = 0 as tampered from documents, steps),
placed as (select *, row_number() over () as id, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by tree) as size from doc),
node(level, tree, place, size, h) as (select 0, tree, place, size, leaf from placed union all
    select level + 1, tree, place // 2, (size + 1) // 2, sha256(string_agg(h, '' order by place)) from node where size > 1 group by level, tree, place // 2, size),
subroot as (select tree, h, row_number() over (order by encode(tree)) - 1 as place, count(*) over () as size from node where size = 1),
top(level, place, size, h) as (select 0, place, size, h from subroot union all
    select level + 1, place // 2, (size + 1) // 2, sha256(string_agg(h, '' order by place)) from top where size > 1 group by level, place // 2, size),
path as (select id, level, a.place >> level & 1 as is_right, b.h as h from placed a join (select level, tree, place, size, h from node) s on s.tree = a.tree and s.place = a.place >> level and s.size > 1 left join (select level as l, tree, place, h from node) b on b.tree = a.tree and b.l = level and b.place = xor(a.place >> level, 1)
    union all select id, 1000 + level, t.place >> level & 1, b.h from placed a join subroot t on t.tree = a.tree join top s on s.place = t.place >> level and s.size > 1 left join (select level as l, place, h from top) b on b.l = level and b.place = xor(t.place >> level, 1)),
steps_of as (select id, list(struct_pack(r := is_right, h := coalesce(h, '')) order by level) as steps from path group by id),
fold(id, k, h) as (select id, 1, case when tampered and n_chars is not null then more else leaf end from placed union all
    select f.id, k + 1, sha256(case when steps[k].r = 1 then steps[k].h || f.h else f.h || steps[k].h end) from fold f join steps_of s on s.id = f.id where k <= len(steps)),
ended as (select id, arg_max(h, k) as folded_root from fold group by id)
select doc_id, leaf, t.h as subroot, r.h as root, sha256(coalesce(array_to_string(list_transform(s.steps, lambda x: x.h), ''), '')) as proof_sha256, folded_root, folded_root = r.h as verified
from placed p join subroot t on t.tree = p.tree join (select h from top where size = 1) r on true left join steps_of s on s.id = p.id join ended e on e.id = p.id"""

QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
ORACLE_SQL = {"op12_merkle_manifest": MANIFEST_SQL}
