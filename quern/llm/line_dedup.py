"""Removal of repeated three-line windows, with DataFrame functions only.

Every three consecutive lines of a document (cut at \\n) form a window; a window counts if at least one of its lines has
a character other than white space. A window occurs later if an equal one starts earlier: in a document with a smaller
key, or further up in the same document. Lines that later windows cover go, overlaps merged; the others stay as they are.

Lines are hashed once, windows are hashed from their lines' hashes (two independent 64-bit hashes), so a window is 16
bytes in the exchanges. Windows are counted with partial aggregation, the few that repeat are joined back.

Defined cases: a null text stays null and has 0 lines; an empty text is one empty line; documents under three lines have
no window and stay; rows with equal key and text are one document, all of which get the same result; rows with equal key
and different texts are different documents, in the order of a hash of their texts; an empty table gives an empty result;
rows without a key lose no lines, though their windows count as first places; columns other than key and text stay with the
rows they came with, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import let, read

LINES = 3


def repeated_windows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tag, positions): for documents with later windows, the lines at which they start; tag is xxhash64(text)."""
    lines = F.split(F.col("text"), "\n", -1)
    base = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.instr("text", "\n") > 0)
    hashed = base.select("key", F.xxhash64("text").alias("tag"), F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g"), F.when(x.rlike(r"[^\s]"), 1).otherwise(0).alias("full"))).alias("x"))
    window = "transform(sequence(0, size(x) - {n}), i -> struct(cast(i as int) as i, xxhash64({h}) as h, xxhash64({g}) as g, {full} as full))".format(
        n=LINES, h=", ".join(f"x[i + {k}].h" for k in range(LINES)), g=", ".join(f"x[i + {k}].g" for k in range(LINES)), full=" + ".join(f"x[i + {k}].full" for k in range(LINES))
    )
    windows = hashed.where(F.size("x") >= LINES).select("key", "tag", F.explode(F.expr(window)).alias("w")).where("w.full > 0").select("key", "tag", "w.i", "w.h", "w.g")
    place = F.struct("key", "tag", "i")
    first = windows.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h", "g", "first")
    later = windows.join(first, ["h", "g"]).where(place > F.col("first"))
    return later.groupBy("key", "tag").agg(F.sort_array(F.collect_set("i")).alias("positions"))


def without(lines: Column, positions: Column) -> Column:
    """struct<lines, gone> of an array of lines without those that windows at the sorted positions cover, in linear time."""
    starts = F.filter(positions, lambda p, i: (i == 0) | (p > F.get(positions, i - 1) + LINES))
    ends = F.filter(positions, lambda p, i: (i == F.size(positions) - 1) | (F.get(positions, i + 1) > p + LINES))

    def cut(x: Column) -> Column:
        n = F.size(x["starts"])
        since = lambda j: F.coalesce(F.get(x["ends"], j - 1) + LINES, F.lit(0))
        upto = lambda j: F.coalesce(F.get(x["starts"], j), F.size(x["lines"]))
        return F.flatten(F.transform(F.sequence(F.lit(0), n), lambda j: F.slice(x["lines"], since(j) + 1, upto(j) - since(j))))

    return let(F.struct(lines.alias("lines"), starts.alias("starts"), ends.alias("ends")), cut)


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the text that is left, and the columns n_lines and n_removed (replacing any of these names)."""
    found = repeated_windows(docs, key, text).select(F.col("key").alias("_key"), F.col("tag").alias("_tag"), "positions")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("key"), F.xxhash64(text).alias("tag"))
    joined = rows.join(found.hint("shuffle_hash"), (F.col("key") == F.col("_key")) & (F.col("tag") == F.col("_tag")), "left")
    own = F.col("row").getField(text)
    left = let(F.col("positions"), lambda p: without(F.split(own, "\n", -1), p))
    n_lines = F.when(own.isNull(), 0).otherwise(F.length(own) - F.length(F.replace(own, F.lit("\n"), F.lit(""))) + 1).cast("long")
    cut = joined.select("row", own.alias("own"), n_lines.alias("n_lines"), F.when(F.col("positions").isNotNull(), F.struct(left.alias("lines"))).alias("cut"))
    gone = F.when(F.col("cut").isNull(), 0).otherwise(F.col("n_lines") - F.size("cut.lines")).cast("long")
    kept = F.when(F.col("cut").isNull(), F.col("own")).otherwise(F.array_join("cut.lines", "\n"))
    columns = [kept.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return cut.select(*columns, "n_lines", gone.alias("n_removed"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


#: The steps as common table expressions over a view {docs}, ending in line_kept(doc_id, n_lines, n_removed, text).
LINE_SQL = """
line_docs as (select doc_id, text, string_split(text, chr(10)) as ls from (select distinct doc_id, text from {docs}) where text is not null),
line_windows as (select doc_id, text, i, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] as w
    from (select doc_id, text, ls, unnest(range(1, len(ls) - 1)) as i from line_docs where len(ls) >= 3)
    where regexp_matches(ls[i] || ls[i + 1] || ls[i + 2], '[^ \\t\\n\\x0b\\f\\r]')),
line_later as (select doc_id, text, i from (select *, row_number() over (partition by w order by doc_id, text, i) as n from line_windows) where n > 1),
line_covered as (select doc_id, text, list(distinct i + k) as c from line_later, (select unnest([0, 1, 2]) as k) group by doc_id, text),
line_kept as (select d.doc_id, case when d.text is null then 0 else len(string_split(d.text, chr(10))) end as n_lines, coalesce(len(c.c), 0) as n_removed,
    case when c.c is null then d.text else array_to_string(list_transform(list_filter(range(1, len(string_split(d.text, chr(10))) + 1), lambda p: not list_contains(c.c, p)), lambda p: string_split(d.text, chr(10))[p]), chr(10)) end as text{extra}
    from {docs} d left join line_covered c on d.doc_id = c.doc_id and d.text = c.text)
"""

QUERIES = {"op4_line_dedup": op4_line_dedup}
ORACLE_SQL = {"op4_line_dedup": "with " + LINE_SQL.format(docs="documents", extra="") + " select * from line_kept"}
