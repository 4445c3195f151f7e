"""Quality rules by hashed n-gram likelihood ratios, with DataFrame functions only.

Base rules are counted from the words and lines of whole texts. The method then compares two multinomials over hashed
n-grams (single tokens and pairs of neighbours; a token is a word with symbol runs cut off): one from the documents that
labels trust, one from the whole raw corpus. A document's verdict is the sum of the log ratios of its n-grams over their
number plus PRIOR n-grams of ratio zero, held against a fixed THRESHOLD. Ratios are integers (in 2^-16), so that sums do
not depend on their order and every run gives the same verdicts.

One pass over the texts writes bucket numbers (12 bits a token) and base counts to the checkpoint folder; counting and
scoring then read only these. What is broadcast or gathered is the table of BUCKETS ratios.

Defined cases: a null text has no words; texts under 10 words fail the base rules; repeated rows each count and each give
a row; an empty corpus gives no rows; without trusted documents all ratios are those of a flat target; other columns are
only kept if they are in `carry`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import read, shared_folder

BUCKETS, PRIOR, SCALE, THRESHOLD_TENTHS = 4096, 10, 65536, -1  # verdict: mean log ratio >= -0.1
SYMBOLS = "#*$%&|<>"
TOKEN_SYMBOLS = r"([#*$%&|<>]+|!!+)"
WINDOW = 5


def without(text: Column, characters: str, put: str = "") -> Column:
    """text with each of the characters replaced; a search for a whole string each, which is quicker than a pattern."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(put))
    return text


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(without(text, "\t\n\x0b\x0c\r", " "), " ", -1), "")


def hashes(words: str) -> Column:
    """CRC-32 of each word."""
    return F.transform(words, lambda x: F.crc32(x.cast("binary")))


def repeat_columns(df: DataFrame, words: str = "_words", hashed: str = "_hashes") -> DataFrame:
    """df with _n_repeat_words. Windows are compared by hash first; only texts in which two hashes agree compare strings."""
    # Hashes of two, four and five neighbours; the last places, which have no window, are cut off.
    two = f"zip_with({hashed}, slice({hashed}, 2, size({hashed})), (a, b) -> xxhash64(a, b))"
    df = df.withColumn("_two", F.expr(two)).withColumn("_four", F.expr("zip_with(_two, slice(_two, 3, size(_two)), (a, b) -> xxhash64(a, b))"))
    df = df.withColumn("_five", F.expr(f"if(size({hashed}) < {WINDOW}, cast(array() as array<bigint>), slice(zip_with(_four, slice({hashed}, 5, size({hashed})), (a, b) -> xxhash64(a, b)), 1, size({hashed}) - {WINDOW - 1}))"))
    df = df.withColumn("_twice", F.size(F.array_distinct("_five")) < F.size("_five")).drop("_two", "_four")
    equal = "filter({0}, (x, k) -> (k > 0 and x.s = {0}[greatest(k - 1, 0)].s) or (k + 1 < size({0}) and x.s = {0}[least(k + 1, size({0}) - 1)].s))"
    df = df.withColumn("_sorted", F.expr("if(_twice, sort_array(transform(_five, (h, i) -> struct(h as s, i as i))), null)"))
    df = df.withColumn("_found", F.expr(equal.format("_sorted"))).drop("_five", "_sorted")
    df = df.withColumn("_sorted", F.expr(f"sort_array(transform(_found, x -> struct(array_join(slice({words}, x.i + 1, {WINDOW}), ' ') as s, x.i as i)))"))
    df = df.withColumn("_places", F.expr(f"sort_array(transform({equal.format('_sorted')}, x -> x.i))"))
    count = f"aggregate(_places, struct(0 as upto, 0L as n), (a, p) -> struct(p + {WINDOW} as upto, a.n + p + {WINDOW} - greatest(p, a.upto) as n), a -> a.n)"
    return df.withColumn("_n_repeat_words", F.coalesce(F.expr(count), F.lit(0).cast("long"))).drop("_twice", "_found", "_sorted", "_places")


def features(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """The carried columns, the base counts (names start with _) and _buckets, for each row of docs."""
    df = docs.select(*carry, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    size = F.length("_text")
    has_symbols = F.col("_text").rlike(f"[{SYMBOLS}]")
    df = df.withColumns({
        "_words": words_of(F.col("_text")),
        "_lines": lines,
        "_n_symbols": F.when(has_symbols, size - F.length(without(F.col("_text"), SYMBOLS))).otherwise(0).cast("long"),
    })
    marked = (F.col("_n_symbols") > 0) | F.contains("_text", F.lit("!!"))
    tokens = words_of(F.regexp_replace("_text", TOKEN_SYMBOLS, " $1 "))
    df = df.withColumns({
        "_n_words": F.size("_words").cast("long"),
        "_word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "_n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_hashes": hashes("_words"),
        "_tokens": F.when(marked, tokens),
    }).drop("_lines", "_text")
    df = df.withColumn("_buckets", F.transform(F.when(F.col("_tokens").isNull(), F.col("_hashes")).otherwise(hashes("_tokens")), lambda h: (h % BUCKETS).cast("smallint")))
    return repeat_columns(df.drop("_tokens")).drop("_words", "_hashes")


def _pairs(buckets: str = "_buckets") -> str:
    """The bucket numbers of neighbouring tokens."""
    return f"if(size({buckets}) < 2, cast(array() as array<smallint>), zip_with(slice({buckets}, 1, size({buckets}) - 1), slice({buckets}, 2, size({buckets}) - 1), (a, b) -> cast((a * 31 + b) % {BUCKETS} as smallint)))"


def ratios(table: DataFrame, trusted: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row with w, the array of BUCKETS scaled log ratios. table: key and _buckets of all documents; trusted: keys."""
    flagged = table.select(key, "_buckets").join(trusted.select(F.col(key).alias("_t")).distinct().hint("shuffle_hash"), F.col(key) == F.col("_t"), "left")
    grams = flagged.select(F.col("_t").isNotNull().cast("long").alias("t"), F.explode(F.concat("_buckets", F.expr(_pairs()))).alias("b"))
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
    filled = table.sparkSession.range(0, BUCKETS, 1, 1).join(F.broadcast(counts), F.col("id") == F.col("b"), "left").na.fill(0, ["raw", "target"])
    row = filled.agg(F.sort_array(F.collect_list(F.struct("id", "raw", "target"))).alias("x"), F.sum("raw").alias("r"), F.sum("target").alias("t"))
    ratio = f"transform(x, e -> cast(round((ln((e.target + 1.0D) / (t + {BUCKETS})) - ln((e.raw + 1.0D) / (r + {BUCKETS}))) * {SCALE}) as bigint))"
    return row.select(F.expr(ratio).alias("w"))


def judged(table: DataFrame, w: Column) -> DataFrame:
    """table with base_failed and kept; w is the array of ratios."""
    table = table.withColumn("_w", w)
    score = f"aggregate(_buckets, 0L, (a, b) -> a + _w[b]) + aggregate({_pairs()}, 0L, (a, b) -> a + _w[b])"
    grams = "greatest(2 * size(_buckets) - 1, 0)"
    failed = "_n_words < 10 or 100 * _n_repeat_words > 20 * _n_words"
    return table.withColumns({"base_failed": F.expr(failed), "kept": F.expr(f"not ({failed}) and 10 * ({score}) >= {THRESHOLD_TENTHS * SCALE}L * ({grams} + {PRIOR})")}).drop("_w")


def quality(docs: DataFrame, labels: DataFrame, carry: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The carried columns (key among them) with _n_words and the other base counts, base_failed and kept."""
    spark = docs.sparkSession
    at = f"{shared_folder(spark)}/quality-{uuid.uuid4().hex}"
    features(docs, carry, text).write.parquet(at)
    table = spark.read.parquet(at)
    found = ratios(table, labels.where("quality = 1"), key)
    return judged(table, F.lit(found.first()["w"])).drop("_buckets")


def passing(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that are kept, unchanged. No copy of them is written: features are made once to count and once to judge."""
    found = ratios(features(docs, [key], text), labels.where("quality = 1"), key)
    table = judged(features(docs, docs.columns, text), F.lit(found.first()["w"]))
    return table.select(F.inline(F.array(F.struct("kept", F.struct(*docs.columns).alias("row"))))).where("kept").select("row.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ["doc_id"])
    return found.select("doc_id", *(F.col(f"_{n}").alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept")


#: Common table expressions over the views {docs} and labels, ending in quality_kept.
QUALITY_SQL = f"""
q_docs as (select row_number() over () as row, doc_id, coalesce(text, '') as text from {{docs}}),
q_words as (select row, doc_id, text, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') as w,
    list_filter(regexp_split_to_array(regexp_replace(text, '{TOKEN_SYMBOLS}', ' \\1 ', 'g'), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') as t,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0b\\f\\r]')) as ls from q_docs),
q_windows as (select row, i, array_to_string(w[i:i + 4], ' ') as s from (select row, w, unnest(range(1, len(w) - 3)) as i from q_words where len(w) >= 5)),
q_twice as (select row, i from (select row, i, count(*) over (partition by row, s) as n from q_windows) where n > 1),
q_repeat as (select row, sum(least(5, nxt - i)) as n from (select row, i, coalesce(lead(i) over (partition by row order by i), i + 5) as nxt from q_twice) group by row),
q_steps as (select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, cast(i as bigint)) order by i) as steps from range(256) r(i)),
q_tokens as (select x, xor(list_reduce(range(octet_length(encode(x))), lambda c, k: xor(c >> 8, steps[(xor(c, cast('0x' || substr(hex(encode(x)), 2 * k + 1, 2) as bigint)) & 255) + 1]), cast(4294967295 as bigint)), 4294967295) % {BUCKETS} as b
    from (select distinct unnest(t) as x from q_words), q_steps),
q_buckets as (select d.row, any_value(d.doc_id) as doc_id, list(k.b order by d.i) filter (d.i is not null) as b from (select row, doc_id, unnest(t) as x, unnest(range(len(t))) as i from q_words) d join q_tokens k on d.x = k.x group by d.row),
q_grams as (select row, doc_id, b || list_transform(range(1, len(b)), lambda i: (b[i] * 31 + b[i + 1]) % {BUCKETS}) as g from q_buckets),
q_flat as (select row, unnest(g) as b, doc_id in (select doc_id from labels where quality = 1) as t from q_grams),
q_counts as (select b, count(*) as raw, count(*) filter (t) as target from q_flat group by b),
q_totals as (select sum(raw) as r, sum(target) as t from q_counts),
q_ratios as (select b, cast(round((ln((target + 1.0::double) / (t + {BUCKETS})) - ln((raw + 1.0::double) / (r + {BUCKETS}))) * {SCALE}) as bigint) as w from q_counts, q_totals),
q_scores as (select row, sum(w) as s, count(*) as n from q_flat join q_ratios using (b) group by row),
quality_kept as (select d.row, d.doc_id, len(w) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
    length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines, cast(coalesce(p.n, 0) as bigint) as n_repeat_words,
    len(w) < 10 or 100 * coalesce(p.n, 0) > 20 * len(w) as base_failed,
    not (len(w) < 10 or 100 * coalesce(p.n, 0) > 20 * len(w)) and 10 * coalesce(c.s, 0) >= {THRESHOLD_TENTHS * SCALE} * (coalesce(c.n, 0) + {PRIOR}) as kept
    from q_words d left join q_repeat p on d.row = p.row left join q_scores c on d.row = c.row)
"""

QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLE_SQL = {"op6_quality_rules": "with " + QUALITY_SQL.format(docs="documents") + " select * exclude (row) from quality_kept"}
