"""The reference's operators as named queries over the driver's tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import hashlib
import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import listing, macros, seeds, variants
from quern.operators import accept, ordered, scoring, tables, trees
from quern.sources import sinks
from quern.sources.tables import lines, shared_folder, table, table_stream
from quern.streaming.accept import accepted_stream, run_available, run_updates
from quern.streaming.state import removals, results_of_work, silences

QUERIES: dict = {}
ORACLE_SQL: dict = {}
BASE, THRESHOLD = 200, 180
LINES_SQL = "(select doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as line_no, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents)"
RESULTS_SQL = "(select user_id as job, event_id as seq, cast(floor(value) as bigint) as score, sha256(cast(cast(floor(value) as bigint) as varchar) || event_type) as hash, event_type as source from events)"


def query(sql: str | None = None):
    """Registers the function under its own name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def results(events: DataFrame) -> DataFrame:
    """Events as the ordered results of one search per user."""
    score = F.floor("value").cast("long")
    return events.select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), score.alias("score"), F.sha2(F.concat(score.cast("string"), F.col("event_type")), 256).alias("hash"), F.col("event_type").alias("source"))


# Scores


def _target(docs: DataFrame) -> DataFrame:
    return docs.orderBy("doc_id").limit(1)


@query(f"""with l as {LINES_SQL}, t as (select line, count(*) as m from l where doc_id = (select min(doc_id) from documents) group by line),
    o as (select doc_id, line, count(*) as n from l group by doc_id, line),
    c as (select doc_id, cast(sum(case when m is null then 0 else least(n, m) end) as bigint) as reorderings, cast(sum(n) as bigint) as all_n from o left join t using (line) group by doc_id)
    select doc_id, reorderings, all_n - reorderings as insertions, cast((select sum(m) from t) as bigint) - reorderings as deletions,
    60 * reorderings + 100 * (all_n - reorderings) + 100 * (cast((select sum(m) from t) as bigint) - reorderings) as score from c""")
def bag_score_vs_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scoring.bag_scores(docs, _target(docs))


#: Alignment as common table expressions over {rows}(key, pos, name) and {target}(pos, name), ending in steps(key, tag, i1, i2, j1, j2).
ALIGN_SQL = """cells as (select r.key, r.pos as i, t.pos as j from {rows} r join {target} t on r.name is not distinct from t.name),
    runs as (select key, min(i) as a, min(j) as b, count(*) as n from (select *, i - row_number() over (partition by key, i - j order by i) as g from cells) group by key, i - j, g),
    segs(kind, key, i1, i2, j1, j2) as (select 'open', key, 0::bigint, count(*), 0::bigint, (select count(*) from {target}) from {rows} group by key union all
        select x.kind, key, x.i1, x.i2, x.j1, x.j2 from (select key, unnest([struct_pack(kind := 'equal', i1 := -best.a, i2 := best.n - best.a, j1 := -best.b, j2 := best.n - best.b), struct_pack(kind := 'split', i1 := i1, i2 := i2, j1 := j1, j2 := j2),
            struct_pack(kind := 'open', i1 := i1, i2 := -best.a, j1 := j1, j2 := -best.b), struct_pack(kind := 'open', i1 := best.n - best.a, i2 := i2, j1 := best.n - best.b, j2 := j2)]) as x
            from (select key, i1, i2, j1, j2, max(struct_pack(n := least(n, i2 - a, j2 - b) - skip, a := -(a + skip), b := -(b + skip))) as best from
                (select s.*, a, b, n, greatest(0, i1 - a, j1 - b) as skip from segs s join runs r on s.key = r.key where kind = 'open') where least(n, i2 - a, j2 - b) > skip group by key, i1, i2, j1, j2))),
    steps as (select key, 'equal' as tag, i1, i2, j1, j2 from segs where kind = 'equal' union all
        select key, case when i1 = i2 then 'insert' when j1 = j2 then 'delete' else 'replace' end, i1, i2, j1, j2 from segs o where kind = 'open' and (i1 < i2 or j1 < j2)
        and not exists (select 1 from segs s where s.kind = 'split' and (s.key, s.i1, s.i2, s.j1, s.j2) = (o.key, o.i1, o.i2, o.j1, o.j2))),
    pairs as (select key, i, i - i1 + j1 as j from (select *, unnest(range(i1, i2)) as i from steps where tag = 'equal')),
    more as (select key, unnest(range(i1, i2)) as i from steps where tag <> 'equal'), less as (select key, unnest(range(j1, j2)) as j from steps where tag <> 'equal')"""
STRIPPED_SQL = "trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
#: Lines by their first words and comma-parted fields, and those of the first document as target.
NAMED_SQL = f"""named as (select doc_id as key, line_no as pos, line, {{name}} as name, case when contains(s, ' ') then list_transform(string_split(substr(s, strpos(s, ' ') + 1), ','), lambda line: {STRIPPED_SQL}) else [] end as fields
    from (select *, {STRIPPED_SQL} as s from {LINES_SQL} where doc_id in (select doc_id from documents where text is not null))), aim as (select * from named where key = (select min(doc_id) from documents))"""
_first_word, _whole = (NAMED_SQL.format(name=x) + ", " + ALIGN_SQL.format(rows="named", target="aim") for x in ("split_part(s, ' ', 1)", "s"))


def bags_sql(line: str, rows: str = "named", target: str = "aim") -> str:
    """bags(key, reorderings, insertions, deletions) of lines that only one side of an alignment has."""
    return f"""sided as (select more.key, {line} as line, 1 as n from more join {rows} r on r.key = more.key and r.pos = i union all select less.key, {line}, -1 from less join {target} t on t.pos = j),
    bags as (select key, sum(least(m, l)) as reorderings, sum(m - least(m, l)) as insertions, sum(l - least(m, l)) as deletions from
        (select key, line, count(*) filter (n > 0) as m, count(*) filter (n < 0) as l from sided group by key, line) group by key)"""


@query(f"""with recursive {_first_word}, {bags_sql("line")},
    differ as (select p.key, sum(len(list_filter(range(1, least(len(r.fields), len(t.fields)) + 1), lambda k: r.fields[k] <> t.fields[k])) + abs(len(r.fields) - len(t.fields))) as mismatches
        from pairs p join named r on r.key = p.key and r.pos = p.i join aim t on t.pos = p.j group by p.key)
    select doc_id, cast(case when text is null then {scoring.FAILED} else 5 * coalesce(mismatches, 0) + 60 * coalesce(reorderings, 0) + 100 * coalesce(insertions + deletions, 0) end as bigint) as score,
    cast(coalesce(mismatches, 0) as bigint) as mismatches, cast(coalesce(insertions, 0) as bigint) as insertions, cast(coalesce(deletions, 0) as bigint) as deletions
    from documents d left join bags b on b.key = doc_id left join differ f on f.key = doc_id""")
def align_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scoring.align_scores(docs, _target(docs))


#: Line items as rows of a listing (l_orderkey, pos, row, name, has_symbol), and the longest order's as target.
ITEM_ROWS_SQL = """items as (select l_orderkey as key, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag, l_linestatus) - 1 as pos,
    cast(l_suppkey % 4 as varchar) as k, cast(l_quantity as bigint) as q, l_returnflag as f, l_linestatus as s from lineitem),
    listed as (select key, pos, case when f = 'A' then 'lw' when f = 'R' then 'beq' when s = 'O' then 'jal' else 'addiu' end as name, f not in ('A', 'R') and (s = 'O' or q % 5 = 0) as has_symbol,
    case when f = 'A' then 'lw' || chr(9) || 'a' || k || ',' || 4 * q || '(sp)' when f = 'R' then 'beq' || chr(9) || 'a' || k || ',zero,L' || q % 20 when s = 'O' then 'jal' || chr(9) || 'f' || q % 3
        else 'addiu' || chr(9) || 'v' || k || ',v0,' || case when q % 5 = 0 then '.data+' || q else cast(q % 10 as varchar) end end as row from items),
    goal as (select * from listed where key = (select key from listed group by key order by count(*) desc, key limit 1))"""
#: Line items by the rules above, with the last operand's bracket apart.
_item_fields = "string_split(regexp_replace(split_part({0}.row, chr(9), 2), '[(]', ','), ',')"
_item_ends = "(r.name = 'lw' or (r.name = 'beq' and list_last(string_split(r.row, ',')) <> list_last(string_split(t.row, ','))))"


@query(f"""with recursive {ITEM_ROWS_SQL}, {ALIGN_SQL.format(rows="listed", target="goal")}, {bags_sql("row", "listed", "goal")},
    beside as (select p.key, r.row as a, t.row as b, r.name, t.has_symbol as symbol, {_item_ends} as ends, {_item_fields.format("r")} as x, {_item_fields.format("t")} as y
        from pairs p join listed r on r.key = p.key and r.pos = p.i join goal t on t.pos = p.j where r.row <> t.row),
    cut as (select *, case when name = 'lw' then abs(cast(regexp_extract(a, ',([0-9]+)[(]sp[)]', 1) as bigint) - cast(regexp_extract(b, ',([0-9]+)[(]sp[)]', 1) as bigint)) else 0 end as stack, (name = 'beq' and ends)::int as branch,
        case when name = 'lw' then x[1:1] when ends then x[1:len(x) - 1] else x end as u, case when name = 'lw' then y[1:1] when ends then y[1:len(y) - 1] else y end as v from beside),
    differ as (select key, sum(stack) as stack, sum(branch) as branch, sum(len(list_filter(range(1, least(len(u), len(v)) + 1), lambda k: u[k] <> v[k] and not (symbol and contains(u[k], '.')))) + abs(len(u) - len(v))) as register from cut group by key)
    select key as l_orderkey, cast(coalesce(stack, 0) as bigint) as stack, cast(coalesce(branch, 0) as bigint) as branch, cast(coalesce(register, 0) as bigint) as register, cast(coalesce(reorderings, 0) as bigint) as reorderings,
    cast(coalesce(insertions, 0) as bigint) as insertions, cast(coalesce(deletions, 0) as bigint) as deletions,
    cast(coalesce(stack, 0) + coalesce(branch, 0) + 5 * coalesce(register, 0) + 60 * coalesce(reorderings, 0) + 100 * coalesce(insertions + deletions, 0) as bigint) as score
    from (select distinct key from listed) left join differ using (key) left join bags using (key)""")
def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a listing, its lines being operations, scored by all six penalties against the order with the most lines."""
    items, columns = table(spark, sf_dir, "lineitem"), ["pos", "row", "name", "has_symbol"]
    rows = _item_rows(items).select("l_orderkey", *columns)
    longest = items.groupBy("l_orderkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_orderkey").limit(1)  # one row
    target = _item_rows(items.join(F.broadcast(longest.select("l_orderkey")), "l_orderkey")).select(*columns)
    return scoring.listing_scores(rows, target, "l_orderkey", "pos", "mips")


def _item_rows(items: DataFrame) -> DataFrame:
    """ITEM_ROWS_SQL's rows, with q, the quantity, and l_partkey."""
    names = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus")
    place = (F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*names)) - 1).cast("long")  # an order has few lines
    k, q, f, s = (F.col("l_suppkey") % 4).cast("string"), F.col("l_quantity").cast("long"), F.col("l_returnflag"), F.col("l_linestatus")
    last = F.when(q % 5 == 0, F.concat(F.lit(".data+"), q.cast("string"))).otherwise((q % 10).cast("string"))
    join = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    row = F.when(f == "A", join("lw\ta", k, ",", (4 * q).cast("string"), "(sp)")).when(f == "R", join("beq\ta", k, ",zero,L", (q % 20).cast("string")))
    row = row.when(s == "O", join("jal\tf", (q % 3).cast("string"))).otherwise(join("addiu\tv", k, ",v0,", last))
    return items.select("l_orderkey", place.alias("pos"), row.alias("row"), F.substring_index(row, "\t", 1).alias("name"), (~f.isin("A", "R") & ((s == "O") | (q % 5 == 0))).alias("has_symbol"), q.alias("q"), "l_partkey")


@query("""with f as (select user_id, event_id, event_type, cast(floor(value) as bigint) as v, props, lag(event_type) over w as pt, lag(cast(floor(value) as bigint)) over w as pv, lag(props) over w as pp from events window w as (partition by user_id order by event_id))
    select event_id, (event_type <> pt)::int + (v <> pv)::int + (props <> pp)::int as mismatches from f where pt is not null""")
def field_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("f", F.array("event_type", F.floor("value").cast("string"), "props"))
    pairs = ordered.as_of(events, "user_id", "event_id", F.col("f"), "before").where("before is not null")
    return pairs.select("event_id", scoring.field_mismatches(F.col("f"), F.col("before")).alias("mismatches"))


#: Bags of event types: of each user (n), and of the user before (m), for users that have events.
BAGS_SQL = "with c as (select user_id, event_type, count(*) as n from events group by 1, 2), b as (select coalesce(c.user_id, p.user_id + 1) as user_id, coalesce(c.event_type, p.event_type) as event_type, coalesce(c.n, 0) as n, coalesce(p.n, 0) as m from c full join c p on c.user_id = p.user_id + 1 and c.event_type = p.event_type)"


def _bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_type, n, m): each user's bag against that of the user before, by counts."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    before = counts.select((F.col("user_id") + 1).alias("user_id"), "event_type", F.col("n").alias("m"))
    both = counts.join(before, ["user_id", "event_type"], "full")
    return both.select("user_id", "event_type", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m")).join(counts.select("user_id").distinct(), "user_id", "left_semi")


@query(f"{BAGS_SQL} select user_id, event_type, least(n, m) as lines from b where least(n, m) > 0 and user_id in (select user_id from c)")
def reordered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bags(spark, sf_dir).select("user_id", "event_type", F.least("n", "m").alias("lines")).where("lines > 0")


@query(f"{BAGS_SQL} select user_id, event_type, n - m as lines from b where n > m and user_id in (select user_id from c)")
def inserted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bags(spark, sf_dir).where("n > m").selectExpr("user_id", "event_type", "n - m as lines")


@query(f"{BAGS_SQL} select user_id, event_type, m - n as lines from b where m > n and user_id in (select user_id from c)")
def deleted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bags(spark, sf_dir).where("m > n").selectExpr("user_id", "event_type", "m - n as lines")


@query("""with c as (select event_type, chr(cast(64 + row_number() over (order by event_type) as integer)) as c from (select distinct event_type from events)),
    s as (select user_id, string_agg(c, '' order by event_id) as s from events join c using (event_type) group by user_id)
    select user_id, levenshtein(s, (select s from s where user_id = (select min(user_id) from s))) as distance from s""")
def mnemonic_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return scoring.distances(events, events.agg(F.min("user_id")).first()[0], "user_id", "event_id", "event_type")


# Enumeration


def _names(spark: SparkSession, sf_dir: str, name: str) -> list[str]:
    """The options of a choice: the names of a table of fixed size."""
    key, column = {"region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name")}[name]
    return [r[0] for r in table(spark, sf_dir, name).orderBy(key).select(column).collect()]


@query("""with r as (select list(r_name order by r_regionkey) as r from region), n as (select list(n_name order by n_nationkey) as n from nation)
    select s as seed, r[s % 5 + 1] || '-' || cast(1 + (s // 5) % 3 as varchar) || '-' || n[(s // 15) % 25 + 1] as variant from range(375) t(s), r, n""")
def enumerate_mixed_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {t: variants.choice(*map(variants.text, _names(spark, sf_dir, t))) for t in ("region", "nation")}
    return variants.enumerated(spark, variants.combine(names["region"], variants.text("-"), variants.integer(1, 3), variants.text("-"), names["nation"]))


@query("""with recursive n as (select list(r_name order by r_regionkey) as r from region), t(seed, rest, s, out) as (
    select i, r, i, [] ::varchar[] from range(120) x(i), n union all
    select seed, rest[1:s % len(rest)] || rest[s % len(rest) + 2:len(rest)], s // len(rest), list_append(out, rest[s % len(rest) + 1]) from t where len(rest) > 0)
    select seed, array_to_string(out, chr(10)) as variant from t where len(rest) = 0""")
def enumerate_lehmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.enumerated(spark, variants.orders([variants.text(n) for n in _names(spark, sf_dir, "region")]))


@query("""with r as (select list(r_name order by r_regionkey) as r from region)
    select s as seed, case when s % 3 = 0 then r[(s // 3) % 5 + 1] else '' end || ':' || case when s % 3 = 1 then 'x' else '' end || r[(s // 15) % 5 + 1] || case when s % 3 = 2 then 'y' else '' end || r[(s // 15) % 5 + 1] as variant from range(75) t(s), r""")
def once_and_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = variants.choice(*map(variants.text, _names(spark, sf_dir, "region")))
    body = variants.combine(variants.once("k", names), variants.text(":"), variants.set_variable("v", names), variants.once("k", variants.text("x")), variants.variable("v"), variants.once("k", variants.text("y")), variants.variable("v"))
    return variants.enumerated(spark, variants.with_once(body))


#: A macro text with nested choices, an escaped comma, a key of two places, a variable that one choice sets, and lines in any order.
MACROS = "PERM_VAR(v,)f(PERM_GENERAL(1,PERM_GENERAL(x(,)y,g(2, 3)),PERM_INT(7,8)));PERM_GENERAL(s;,PERM_VAR(v,t;))PERM_ONCE(k,a;)b;PERM_ONCE(k,c;)PERM_VAR(v)PERM_LINESWAP(p,q;\nr;\n)"


@query("""select c_custkey, 'f(' || (['1', 'x,y', 'g(2, 3)', '7', '8'])[(s // 2) % 5 + 1] || ');' || (['s;', ''])[(s // 10) % 2 + 1] || (['a;b;', 'b;c;'])[s % 2 + 1] || (['', 't;'])[(s // 10) % 2 + 1]
    || (['p,q;' || chr(10) || 'r;', 'r;' || chr(10) || 'p,q;'])[(s // 20) % 2 + 1] as variant from (select c_custkey, c_custkey % 40 as s from customer)""")
def enumerate_macros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's variant of a macro text of 40, their keys being the seeds."""
    space = macros.parsed(MACROS)
    return table(spark, sf_dir, "customer").select("c_custkey", space.decode(F.col("c_custkey") % space.size, {}).alias("variant"))


# Acceptance


def _accept_sql(better_only: bool = False, best_only: bool = False, threshold: int | None = None, source: str = RESULTS_SQL, base_hash: str | None = None) -> str:
    static = f"source is not null and score {'<' if better_only else '<='} {BASE}" + (f" and score < {threshold}" if threshold is not None else "") + (f" and hash <> '{base_hash}'" if base_hash else "")
    return f"""with s as (select * from {source} where {static}),
    w as (select *, row_number() over (partition by job, hash order by seq) as nth, least({BASE}, coalesce(min(score) over (partition by job order by seq rows between unbounded preceding and 1 preceding), {BASE})) as best_before from s)
    select job, seq, score, hash, best_before from w where (nth = 1 or score = 0)""" + (" and score <= best_before" if best_only else "")


def _accepted(spark: SparkSession, sf_dir: str, **flags) -> DataFrame:
    return accept.accepted(results(table(spark, sf_dir, "events")), BASE, **flags).select("job", "seq", "score", "hash", "best_before")


@query(_accept_sql())
def accept_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accepted(spark, sf_dir)


@query(_accept_sql(better_only=True))
def accept_better_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accepted(spark, sf_dir, better_only=True)


@query(_accept_sql(best_only=True, threshold=THRESHOLD))
def accept_best_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accepted(spark, sf_dir, best_only=True, threshold=THRESHOLD)


#: The hash of the base: a result with the score 100 and source "click" has it.
BASE_HASH = hashlib.sha256(b"100click").hexdigest()


@query(_accept_sql(base_hash=BASE_HASH))
def accept_other_than_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accepted(spark, sf_dir, base_hash=BASE_HASH)


@query(_accept_sql(threshold=THRESHOLD))
def accept_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accepted(spark, sf_dir, threshold=THRESHOLD)


@query(_accept_sql(source=f"(select * from {RESULTS_SQL} qualify row_number() over (partition by job, score, source order by seq) = 1)"))
def accept_first_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = accept.first_by_source(results(table(spark, sf_dir, "events")).withColumn("source", F.concat_ws(":", "score", "source")))
    return accept.accepted(first, BASE).select("job", "seq", "score", "hash", "best_before")


@query(_accept_sql(best_only=True, threshold=THRESHOLD))
def stream_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = table_stream(spark, sf_dir, "events")
    return run_available(accepted_stream(results(stream), BASE, best_only=True, threshold=THRESHOLD), shared_folder(spark))


@query(_accept_sql(better_only=True, base_hash=BASE_HASH))
def stream_accept_better(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = table_stream(spark, sf_dir, "events")
    return run_available(accepted_stream(results(stream), BASE, better_only=True, base_hash=BASE_HASH), shared_folder(spark))


@query(f"select job, seq, score, case when score <= {BASE} then hash end as hash, case when score <= {BASE} then source end as source from {RESULTS_SQL}")
def payload_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash and source go before a shuffle where the row can't be put out anyway."""
    return results(table(spark, sf_dir, "events")).select("job", "seq", "score", *(F.when(F.col("score") <= BASE, F.col(c)).alias(c) for c in ("hash", "source")))


@query(f"""with w as (select *, least({BASE}, coalesce(min(score) over (partition by job order by seq rows between unbounded preceding and 1 preceding), {BASE})) as best from {RESULTS_SQL})
    select job, seq, score, case when score < best then 'new best' when score = best then 'tied' when score < {BASE} then 'better' when score = {BASE} then 'same score' else 'worse' end as outcome from w""")
def outcome_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accept.labelled(results(table(spark, sf_dir, "events")), BASE).select("job", "seq", "score", "outcome")


@query(f"select job, min(seq) as seq from {RESULTS_SQL} where score = 0 group by job")
def stop_at_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(table(spark, sf_dir, "events")).where("score = 0").groupBy("job").agg(F.min("seq").alias("seq"))


@query(f"select job, score, seq, row_number() over (partition by job, score order by seq) as counter from {RESULTS_SQL}")
def result_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(table(spark, sf_dir, "events")).select("job", "score", "seq", F.struct("job", "score").alias("name"))
    return ordered.with_running(rows, "name", ["seq"], F.lit(1).cast("long"), "counter").drop("name")


# Weights, picks and roll-ups


@query("""select n.n_name as name, coalesce(c.w, s.w, cast(n.n_nationkey * 10 as bigint)) as weight from nation n
    left join (select s_nationkey as k, count(*) as w from supplier group by 1 having sum(s_acctbal) > 5000 * count(*)) s on n.n_nationkey = s.k
    left join (select c_nationkey as k, count(*) as w from customer group by 1 having sum(c_acctbal) < 4500 * count(*)) c on n.n_nationkey = c.k""")
def weight_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")

    def layer(name: str, key: str, rule: str) -> DataFrame:
        """Nations whose mean balance follows the rule, with their numbers of rows: layers in which keys are missing."""
        counts = table(spark, sf_dir, name).groupBy(key).agg(F.count("*").alias("weight"), F.expr(f"{rule} as _rule")).where("_rule")
        return counts.join(nation, counts[key] == nation["n_nationkey"]).select(F.col("n_name").alias("name"), "weight")

    base = nation.select(F.col("n_name").alias("name"), (F.col("n_nationkey") * 10).cast("long").alias("weight"))
    return tables.overlay(base, layer("supplier", "s_nationkey", "sum(s_acctbal) > 5000 * count(*)"), layer("customer", "c_nationkey", "sum(c_acctbal) < 4500 * count(*)"))


@query("""with c as (select p_partkey, p_size, sum(p_size) over (order by p_partkey) as cum from part), t as (select sum(p_size) as t from part),
    k as (select i as pick, cast(concat('0x', substr(sha256(cast(i as varchar) || 'pick'), 1, 15)) as bigint) % t as u from range(20) r(i), t)
    select pick, cast(u as bigint) as u, min(p_partkey) as p_partkey from k join c on cum > u where p_size > 0 group by pick, u""")
def weighted_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("long"))
    total = part.agg(F.sum("p_size")).first()[0]
    picks = spark.range(20).select(F.col("id").alias("pick"), tables.uniform(F.concat(F.col("id").cast("string"), F.lit("pick")), F.lit(total)).alias("u"))
    return ordered.weighted_picks(part, "p_partkey", "p_size", picks)


@query("""select l_orderkey, l_linenumber, cast(round((power(abs(l_linenumber - 4) + 1, -1.5) + (case when l_returnflag = 'N' then 0.5 else 1.0 end)::double / count(*) over (partition by l_orderkey)) * 1000000) as bigint) as weight_millionths from lineitem""")
def distance_decay_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight of each item by how far it is from the fourth line, with an even share among the order's items that depends on its kind."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    n = items.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    share = F.when(F.col("l_returnflag") == "N", 0.5).otherwise(1.0) / F.col("n")
    weight = tables.decay(F.abs(F.col("l_linenumber") - 4), share)
    return items.join(n, "l_orderkey").select("l_orderkey", "l_linenumber", F.round(weight * 1000000).cast("long").alias("weight_millionths"))


@query("""with s as (select event_type, sum(cast(value as decimal(18,2))) as v from events group by event_type)
    select event_type, cast(v * 100 as bigint) as cents, cast(round_even(cast(100 * v as double) / cast((select sum(v) from s) as double), 0) as bigint) as percent from s""")
def stage_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("v"))
    share = (F.col("v") * 100).cast("double") / F.sum("v").over(Window.partitionBy(F.lit(1))).cast("double")
    return sums.select("event_type", (F.col("v") * 100).cast("long").alias("cents"), F.bround(share, 0).cast("long").alias("percent"))


@query("""select event_type, user_id % 7 as worker, count(*) as n, count(*) filter (value < 50) as improved, count(*) filter (value < 5) as matched from events group by grouping sets ((), (event_type), (user_id % 7))""")
def stats_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("worker", F.col("user_id") % 7)
    sets = events.groupingSets([[], [F.col("event_type")], [F.col("worker")]], "event_type", "worker")
    return sets.agg(F.count("*").alias("n"), F.count_if(F.col("value") < 50).alias("improved"), F.count_if(F.col("value") < 5).alias("matched"))


@query("select count(*) filter (s_nationkey >= 10) as eligible, cast(sum(cast(floor(s_acctbal) as bigint)) filter (s_nationkey >= 10) as bigint) as cores, (select count(*) from customer) as clients from supplier")
def load_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = F.col("s_nationkey") >= 10
    servers = table(spark, sf_dir, "supplier").agg(F.count_if(fits).alias("eligible"), F.sum(F.when(fits, F.floor("s_acctbal").cast("long"))).alias("cores"))
    return servers.join(F.broadcast(table(spark, sf_dir, "customer").agg(F.count("*").alias("clients"))))


@query("""with j as (select c_mktsegment as job, 1 + count(*) % 5 as priority from customer group by 1),
    w as (select job, cast(k as integer) as unit, k * 60 // priority as energy from j, range(1, 31) r(k))
    select job, unit, cast(energy as bigint) as energy, row_number() over (order by energy, job, unit) as position from w""")
def fair_share_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("job")).agg((F.count("*") % 5 + 1).alias("priority"))
    return tables.fair_order(jobs, 30, 60)


@query("""with u as (select event_type as job, event_id as unit, cast(floor(value) as bigint) as d, 1 + length(event_type) % 4 as p from events),
    e as (select job, unit, 60 * (sum(d) over (partition by job order by unit) - d) // p as energy from u)
    select job, unit, cast(energy as bigint) as energy, row_number() over (order by energy, job, unit) as position from e""")
def fair_service_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as work of unequal durations, served by what their types have spent."""
    units = table(spark, sf_dir, "events").select(F.col("event_type").alias("job"), F.col("event_id").alias("unit"), F.floor("value").cast("long").alias("duration"), (F.length("event_type") % 4 + 1).alias("priority"))
    return tables.fair_service(units, 60)


@query("""with h as (select user_id, event_id, sum(case when value < 20 then 3 when value < 60 then 2 else 1 end) over (partition by user_id order by event_id) as s from events)
    select event_id, cast(s // 2 - coalesce(lag(s) over (partition by user_id order by event_id), 0) // 2 as bigint) as units from h""")
def adaptive_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    halves = F.when(F.col("value") < 20, 3).when(F.col("value") < 60, 2).otherwise(1)
    return tables.demand(table(spark, sf_dir, "events"), "user_id", "event_id", halves).select("event_id", "units")


@query("select l_suppkey as job, min(struct_pack(e := cast(floor(l_extendedprice) as bigint), o := l_orderkey, n := l_linenumber)).o as order_key from lineitem group by 1")
def argmin_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    least = F.min(F.struct(F.floor("l_extendedprice").alias("e"), "l_orderkey", "l_linenumber")).alias("x")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("job")).agg(least).select("job", F.col("x.l_orderkey").alias("order_key"))


@query("select p_partkey, case when count(*) over (partition by p_name) > 1 then p_name || '#' || p_partkey else p_name end as display_name from part")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = F.count("*").over(Window.partitionBy("p_name")) > 1
    return table(spark, sf_dir, "part").select("p_partkey", F.when(shared, F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_name")).alias("display_name"))


# Order inside a key


@query("""select event_id, row_number() over (partition by user_id order by event_id) as turn, row_number() over (order by t, user_id) as position from
    (select *, row_number() over (partition by user_id order by event_id) as t from events)""")
def round_robin_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.round_robin(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id").select("event_id", "turn", "position")


@query("select min(doc_id) as doc_id, sha256(coalesce(text, '')) as text_hash from documents group by 2")
def first_seen_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"))
    return hashed.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"))


@query("select event_id, last_value(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as last_write from events")
def asof_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    write = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return ordered.as_of(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", write, "last_write").select("event_id", "last_write")


@query("select event_id, first_value(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by user_id order by event_id rows between current row and unbounded following) as next_write from events")
def asof_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    write = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return ordered.as_of(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", write, "next_write", forward=True, own=True).select("event_id", "next_write")


@query("""with c as (select *, case when event_type = lag(event_type) over (partition by user_id order by event_id) then 0 else 1 end as c from events),
    i as (select *, sum(c) over (partition by user_id order by event_id) as i from c)
    select user_id, event_type, min(event_id) as first, count(*) as length from i group by user_id, event_type, i having count(*) >= 3""")
def runs_ge3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.runs(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", 3)


@query("""with n as (select *, row_number() over (partition by user_id order by event_id) as k from events)
    select a.user_id, a.event_id as a, b.event_id as b from n a join n b on a.user_id = b.user_id and b.k between a.k + 1 and a.k + 4 and a.event_type = b.event_type""")
def pairs_within_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.pairs_within(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", 4)


@query(f"""select doc_id, cast(line_no as integer) as line_no, last_value(case when length(line) < 40 then line end ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and current row) as section from {LINES_SQL}""")
def carry_forward_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(table(spark, sf_dir, "documents"))
    return ordered.carried(rows, "doc_id", "line_no", F.when(F.length("line") < 40, F.col("line")), "section").select("doc_id", "line_no", "section")


@query("select event_id from (select *, sum(case when event_type = 'view' then 0 else 1 end) over (partition by user_id order by event_id rows between current row and unbounded following) as s from events) where s > 0")
def trim_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.without_tail(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "view").select("event_id")


@query("select event_id from (select event_id, lag(event_type) over (partition by user_id order by event_id) as b from events) where b is distinct from 'error'")
def delay_slot_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows but those that follow an error."""
    rows = ordered.neighbour(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", F.col("event_type"), "before")
    return rows.where(~F.col("before").eqNullSafe("error")).select("event_id")


@query("""with g as (select *, sum(case when event_type = 'view' then 0 else 1 end) over (partition by user_id order by event_id) as g from events)
    select min(event_id) as event_id, count(*) - 1 as notes, max(case when event_type = 'view' then event_id end) as last_note from g where g > 0 group by user_id, g""")
def notes_to_row_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as notes on the row before them that is none."""
    is_note = F.col("event_type") == "view"
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    rows = ordered.with_running(events, "user_id", ["event_id"], F.when(is_note, 0).otherwise(1), "head").where("head > 0")
    return rows.groupBy("user_id", "head").agg(F.min("event_id").alias("event_id"), (F.count("*") - 1).alias("notes"), F.max(F.when(is_note, F.col("event_id"))).alias("last_note")).drop("user_id", "head")


@query("select event_id, event_type || coalesce('>' || lead(event_type) over (partition by user_id order by event_id), '') as pair from events")
def next_row_peek(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordered.neighbour(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", F.col("event_type"), "after", forward=True)
    return rows.select("event_id", F.concat("event_type", F.coalesce(F.concat(F.lit(">"), F.col("after")), F.lit(""))).alias("pair"))


@query("select event_id, row_number() over (partition by user_id order by case when event_type = 'error' then 1 else 0 end, event_id) as place from events")
def late_section_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places inside a user's rows when errors go behind all others."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("late"))
    return ordered.with_running(rows, "user_id", ["late", "event_id"], F.lit(1).cast("long"), "place").select("event_id", "place")


@query("""select a.l_orderkey, a.l_linenumber as outer_line, b.l_linenumber as inner_line from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey
    where a.l_partkey < b.l_partkey and b.l_partkey + b.l_suppkey < a.l_partkey + a.l_suppkey""")
def interval_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of an order's lines of which the first's interval (part, part + supplier) holds the second's."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") + F.col("l_suppkey")).alias("upto"))
    inner = items.select("l_orderkey", F.col("l_linenumber").alias("inner_line"), F.col("l_partkey").alias("inner_from"), F.col("upto").alias("inner_upto"))
    return items.join(inner, "l_orderkey").where("l_partkey < inner_from and inner_upto < upto").select("l_orderkey", F.col("l_linenumber").alias("outer_line"), "inner_line")


# Joins by name and key


@query("""with e as (select *, user_id in (select c_custkey from customer where c_acctbal > 0) as known from events)
    select 'total' as level, '' as name, count(*) as n, count(*) filter (value < 50) as improved, count(*) filter (value < 5) as matched from e
    union all select 'function', event_type, count(*), count(*) filter (value < 50), count(*) filter (value < 5) from e group by event_type
    union all select 'client', cast(user_id as varchar), count(*), count(*) filter (value < 50), count(*) filter (value < 5) from e where known group by user_id""")
def stats_of_known_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in total, by function and by client; unknown clients count in the first two alone."""
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("known")).distinct()
    events = table(spark, sf_dir, "events")
    rows = events.join(known, events["user_id"] == known["known"], "left").groupBy("event_type", "user_id", "known").agg(F.count("*").alias("n"), F.count_if(F.col("value") < 50).alias("improved"), F.count_if(F.col("value") < 5).alias("matched"))
    levels = F.array(*(F.struct(F.lit(a).alias("level"), b.alias("name")) for a, b in (("total", F.lit("")), ("function", F.col("event_type")), ("client", F.col("known").cast("string")))))
    return rows.select(F.explode(levels).alias("x"), "n", "improved", "matched").where("x.name is not null").groupBy("x.level", "x.name").agg(*(F.sum(c).alias(c) for c in ("n", "improved", "matched")))


@query("select user_id, count(*) as starts from events where event_type = 'signup' group by user_id")
def start_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'signup'").groupBy("user_id").agg(F.count("*").alias("starts"))


@query("select o_orderkey as work, count(l_orderkey) as results from orders left join lineitem on o_orderkey = l_orderkey and l_quantity > 10 group by 1")
def work_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by the work that they belong to; results of no known work are passed over."""
    done = table(spark, sf_dir, "lineitem").where("l_quantity > 10").groupBy(F.col("l_orderkey").alias("work")).agg(F.count("*").alias("results"))
    work = table(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("work")).agg(F.count("*").alias("_n"))
    return work.join(done, "work", "left").select("work", (F.coalesce("results", F.lit(0)) * F.col("_n")).cast("long").alias("results"))


@query("select coalesce(s.k, c.k) as nation, coalesce(s.n, 0) as suppliers, coalesce(c.n, 0) as customers from (select s_nationkey as k, count(*) as n from supplier group by 1) s full join (select c_nationkey as k, count(*) as n from customer group by 1) c on s.k = c.k")
def key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = (table(spark, sf_dir, t).groupBy(F.col(k).alias("nation")).agg(F.count("*").alias(t)) for t, k in (("supplier", "s_nationkey"), ("customer", "c_nationkey")))
    return s.join(c, "nation", "full").select("nation", F.coalesce("supplier", F.lit(0)).cast("long").alias("suppliers"), F.coalesce("customer", F.lit(0)).cast("long").alias("customers"))


@query("select substr(r_name, 1, 2) || '*' as token, n_name as name from region join nation on contains(n_name, substr(r_name, 1, 2))")
def wildcard_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token that ends in * names every name that contains what is before it. Both sides are tables of fixed size."""
    tokens = table(spark, sf_dir, "region").select(F.concat(F.substring("r_name", 1, 2), F.lit("*")).alias("token"))
    return tables.wildcard_edges(tokens, table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")))


@query(f"""with recursive c as (select count(*) as n, cast(ceil(sqrt(count(*))) as bigint) as a from part), d as (select n, a, (n + a - 1) // a as b from c),
    walk(seed, x, i) as (select seed, seed, 0 from (select row_number() over (order by p_partkey) - 1 as seed from part) union all select seed, {seeds.step_sql("x", "order")}, i + 1 from walk, d where i = 0 or x >= n)
    select seed as seed, arg_max(x, i) as place from walk group by seed""")
def seed_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seed of a space with as many variants as there are parts, in an order that looks random."""
    n = table(spark, sf_dir, "part").count()
    return seeds.shuffled(spark.range(n).select(F.col("id").alias("seed")), "seed", n, "order") if n else spark.range(0).selectExpr("id as seed", "id as place")


@query("""with recursive n as (select list(n_name order by n_nationkey) as n from nation),
    t(key, seed, rest, s, out) as (select s_suppkey, cast(v as varchar), n, v, [] ::varchar[] from (select s_suppkey, (s_suppkey::hugeint + 1) * 15511210043330985983 * 99991 % 15511210043330985984000000 as v from supplier), n union all
        select key, seed, rest[1:s % len(rest)] || rest[s % len(rest) + 2:len(rest)], s // len(rest), list_append(out, rest[cast(s % len(rest) + 1 as integer)]) from t where len(rest) > 0)
    select seed, array_to_string(out, chr(10)) as variant from t where len(rest) = 0""")
def large_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's own of the 25! orders of the nations, which are more than a long counts."""
    space = variants.orders([variants.text(n) for n in _names(spark, sf_dir, "nation")])
    one, size = (F.lit(str(x)).cast("decimal(38,0)") for x in (15511210043330985983, math.factorial(25)))
    seed = (F.col("s_suppkey").cast("decimal(6,0)") + 1) * one * F.lit(99991).cast("decimal(5,0)") % size
    return variants.decoded(table(spark, sf_dir, "supplier").select(seed.cast("string").alias("seed")), "seed", space)


@query("""with r as (select list(r_name order by r_regionkey) as r from region), n as (select list(n_name order by n_nationkey) as n from nation)
    select s as seed, r[s % 5 + 1] || '-' || cast(1 + (s // 5) % 3 as varchar) || '-' || n[(s // 15) % 25 + 1] as variant from (select unnest([0, 17, 374]) as s), r, n""")
def forced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {t: variants.choice(*map(variants.text, _names(spark, sf_dir, t))) for t in ("region", "nation")}
    return variants.at_seeds(spark, variants.combine(names["region"], variants.text("-"), variants.integer(1, 3), variants.text("-"), names["nation"]), [0, 17, 374])


@query(f"select job, count(*) || case when count(*) = 1 then ' result' else ' results' end as label from {RESULTS_SQL} group by job")
def plural_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(table(spark, sf_dir, "events")).groupBy("job").agg(F.count("*").alias("n")).select("job", F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " result").otherwise(" results")).alias("label"))


@query("select p_partkey, cast(p_size as bigint) as size, cast(a as bigint) as a, cast(p_size // a as bigint) as b from part, range(1, 101) r(a) where a * a <= p_size and p_size % a = 0")
def factor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("long")
    a = F.filter(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1), F.floor(F.sqrt(size))).cast("long")), lambda x: (size % x == 0) & (x * x <= size))
    return table(spark, sf_dir, "part").select("p_partkey", size.alias("size"), F.explode(a).alias("a")).withColumn("b", F.call_function("div", F.col("size"), F.col("a")))


# Text


@query(rf"""select doc_id, cast(line_no as integer) as line_no, rtrim(regexp_replace(regexp_replace(regexp_replace(line, '[ \t]*(//|;|\|).*$', '', 'g'), '<[^<>]*>', '<target>', 'g'), '[0-9]+', 'imm', 'g'), ' ') as line from {LINES_SQL}""")
def normalize_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(table(spark, sf_dir, "documents")).select("doc_id", "line_no", listing.normal(F.col("line")).alias("line"))


@query("select doc_id, sha256(regexp_replace(coalesce(text, ''), '[0-9]+', 'imm', 'g')) as fingerprint from documents")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(listing.numbers_as_one(F.coalesce("text", F.lit(""))), 256).alias("fingerprint"))


@query("""select doc_id, case when strpos(text, 'License') > 0 then list_last(string_split(left(text, strpos(text, 'License') - 1), chr(10))) || substr(text, strpos(text, 'License')) else text end as text from documents""")
def context_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", listing.from_line_with(F.col("text"), "License").alias("text"))


@query("select event_id, cast(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) as integer) as k from events")
def message_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("select min(event_id) as event_id, props as message, count(*) as n from events where event_type = 'error' group by props")
def error_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = table(spark, sf_dir, "events").where("event_type = 'error'")
    return errors.groupBy(F.col("props").alias("message")).agg(F.min("event_id").alias("event_id"), F.count("*").alias("n"))


# Graph


@query("""with recursive e as (select 'p' || l_partkey as src, 's' || l_suppkey as dst from lineitem where l_quantity > 20 union select 's' || l_suppkey, 'p' || l_partkey from lineitem where l_quantity <= 20),
    r(node) as (select 's' || min(s_suppkey) from supplier union select dst from r join e on src = node) select node from r""")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    part, supplier = F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    edges = items.select(*(F.when(F.col("l_quantity") > 20, x).otherwise(y).alias(c) for x, y, c in ((part, supplier, "src"), (supplier, part, "dst")))).distinct()
    roots = table(spark, sf_dir, "supplier").agg(F.concat(F.lit("s"), F.min("s_suppkey").cast("string")).alias("node"))
    return tables.reachable(edges, roots).select("node")


@query("""with recursive e as (select n_name as src, r_name as dst from nation join region on n_regionkey = r_regionkey union all select r_name, substr(r_name, 1, 2) || '*' from region),
    w as (select src, dst from e union select substr(r_name, 1, 2) || '*', e.dst from region join e on contains(e.src, substr(r_name, 1, 2))),
    r(node) as (select min(n_name) from nation union select dst from r join w on src = node) select node from r""")
def wildcard_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations lead to their regions, these to a token, and that to what all names lead to which contain it. Tables of fixed size."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    token = F.concat(F.substring("r_name", 1, 2), F.lit("*"))
    edges = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_name").alias("src"), F.col("r_name").alias("dst")).union(region.select("r_name", token))
    return tables.wildcard_closure(edges, region.select(token.alias("token")), nation.agg(F.min("n_name").alias("node"))).select("node")


@query("""with recursive l as (select p_partkey as node, p_partkey - p_size as up from part where p_size > 0 and p_partkey > p_size),
    r as (select node, up from l union all select r.node, l.up from r join l on r.up = l.node) select node, min(up) as up from r group by node""")
def chain_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the chains end that lead from each part to the one p_size before it."""
    up = (F.col("p_partkey") - F.col("p_size")).alias("up")
    return tables.chain_ends(table(spark, sf_dir, "part").where("p_size > 0 and p_partkey > p_size").select(F.col("p_partkey").alias("node"), up))


@query("""with recursive e as (select 'p' || l_partkey as src, 's' || l_suppkey as dst, bool_and(l_returnflag <> 'N' or l_linestatus = 'F') as weak from lineitem where l_quantity > 40 group by 1, 2
        union select 's' || l_suppkey, 'p' || l_partkey, bool_and(l_returnflag <> 'N' or l_linestatus = 'F') from lineitem where l_quantity <= 2 group by 1, 2),
    r(node) as (select 's' || min(s_suppkey) from supplier union select dst from r join e on src = node where not weak)
    select node, false as weak from r union all select distinct dst, true from r join e on src = node where weak and dst not in (select node from r)""")
def strong_and_weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers that open items lead to, and those that only other items name."""
    items = table(spark, sf_dir, "lineitem").where("l_quantity > 40 or l_quantity <= 2")
    part, supplier = F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    ends = (F.when(F.col("l_quantity") > 40, x).otherwise(y).alias(c) for x, y, c in ((part, supplier, "src"), (supplier, part, "dst")))
    roots = table(spark, sf_dir, "supplier").agg(F.concat(F.lit("s"), F.min("s_suppkey").cast("string")).alias("node"))
    return tables.strong_and_weak(items.select(*ends, ((F.col("l_returnflag") != "N") | (F.col("l_linestatus") == "F")).alias("weak")), roots)


#: Tags of pages that are always closed, and their nodes: html is cut at them, and each opens or closes a node.
TAGS = "</?(?:html|body|nav|ul|li|a|div|article|footer|h1)(?: [^>]*)?>"
TREE_SQL = f"""t as (select page_id, unnest(range(len(ts))) as pos, unnest(ts) as tag from (select page_id, regexp_extract_all(html, '{TAGS}') as ts from pages)),
    u as (select page_id, pos, case when tag like '</%' then -1 else 1 end as step, regexp_extract(tag, '[a-z0-9]+') as label from t),
    d as (select *, sum(step) over (partition by page_id order by pos) as depth from u),
    n as (select page_id, pos as node, label, depth - 1 as depth, (select min(c.pos) from d c where c.page_id = o.page_id and c.pos > o.pos and c.depth = o.depth - 1) as upto from d o where step = 1),
    s as (select page_id, node, any_value(n.label) as label, any_value(n.depth) as depth, any_value(upto) as upto, count(*) as size, string_agg((d.depth - 1 - n.depth) || d.label, ',' order by pos) as serial
        from n join d using (page_id) where d.step = 1 and pos >= node and pos < coalesce(upto, pos + 1) group by page_id, node)"""


def _page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "pages").select(F.col("page_id").alias("tree"), F.posexplode(F.regexp_extract_all("html", F.lit(TAGS), F.lit(0))).alias("pos", "tag"))
    step = F.when(F.startswith("tag", F.lit("</")), -1).otherwise(1)
    return trees.nodes(tags.select("tree", F.col("pos").cast("long").alias("pos"), step.alias("step"), F.regexp_extract("tag", "[a-z0-9]+", 0).alias("label")))


@query(f"""with {TREE_SQL} select page_id, node, label, cast(depth as bigint) as depth, (select max(p.node) from n p where p.page_id = s.page_id and p.depth = s.depth - 1 and p.node < s.node) as parent, upto as "end" from s""")
def page_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of each page with their parents and where they end, by the depth of their tags."""
    return _page_nodes(spark, sf_dir).select(F.col("tree").alias("page_id"), "node", "label", "depth", "parent", "end")


@query(f"with {TREE_SQL} select min(struct_pack(p := page_id, n := node)).p as page_id, min(struct_pack(p := page_id, n := node)).n as node, any_value(size) as size, count(*) as n from s where size >= 2 group by serial having count(*) > 1")
def repeated_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of two elements or more that several places of the pages have, each with the first of them."""
    found = trees.repeated(trees.hashed(_page_nodes(spark, sf_dir)))
    return found.select(F.col("tree").alias("page_id"), "node", "size", "n")


@query("select event_type, user_id % 7 as server, user_id as client, count(*) as n, count(*) filter (value < 50) as improved, count(*) filter (value < 5) as matched from events group by grouping sets ((), (event_type), (user_id % 7), (user_id))")
def stats_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes in total, by function, by server and by client, from one pass over counts by all three."""
    events = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 7).alias("server"), F.col("user_id").alias("client"), "value")
    levels = [[], [F.col("event_type")], [F.col("server")], [F.col("client")]]
    return events.groupingSets(levels, "event_type", "server", "client").agg(F.count("*").alias("n"), F.count_if(F.col("value") < 50).alias("improved"), F.count_if(F.col("value") < 5).alias("matched"))


@query(f"""with r as (select job, case when source = 'error' and score % 2 = 0 then {scoring.FAILED} else score end as score, source = 'error' and score % 2 = 1 as internal from {RESULTS_SQL})
    select job, count(*) as iterations, count(*) filter (internal or score >= {scoring.FAILED}) as errors, count(*) filter (internal) as internal_errors, min(score) filter (not internal and score < {scoring.FAILED}) as best from r group by job""")
def error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Iterations and errors of each job: failed evaluations, which score infinitely, and internal ones, which have no score."""
    rows = results(table(spark, sf_dir, "events"))
    internal = (F.col("source") == "error") & (F.col("score") % 2 == 1)
    rows = rows.select("job", internal.alias("internal"), F.when((F.col("source") == "error") & (F.col("score") % 2 == 0), scoring.FAILED).otherwise(F.col("score")).alias("score"))
    return scoring.error_counts(rows, "job", F.col("internal"))


@query(f"""with l as (select doc_id, line_no from {LINES_SQL}), m as (select *, count(*) over (partition by doc_id) as n from l),
    k as (select doc_id, line_no, line_no % 4 = 1 and line_no + 2 < n as starts, line_no % 4 = 3 as ends from m where line_no < n - n % 4),
    g as (select doc_id, line_no, starts, ends, sum(case when starts then 1 else 0 end) over (partition by doc_id order by line_no) as g, sum(case when starts then 1 when ends then -1 else 0 end) over (partition by doc_id order by line_no) as depth from k),
    r as (select doc_id, g, min(line_no) as first, max(line_no) as last from g where depth = 1 and not starts group by doc_id, g),
    c as (select doc_id, arg_min(struct_pack(first := first, last := last), sha256(doc_id || ':' || first || ':pick')) as at from r group by doc_id)
    select g.doc_id, cast(g.line_no as integer) as line_no from g left join c using (doc_id) where not starts and not ends and (c.at is null or g.line_no between c.at.first and c.at.last)""")
def region_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one region of each document: of every four lines the second starts a region and the fourth ends it."""
    rows = lines(table(spark, sf_dir, "documents"))
    n = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    fours = rows.join(n, "doc_id").where(F.col("line_no") < F.col("n") - F.col("n") % 4).select("doc_id", "line_no", "n")
    starts, ends = (F.col("line_no") % 4 == 1) & (F.col("line_no") + 2 < F.col("n")), F.col("line_no") % 4 == 3
    return ordered.chosen_region(fours, "doc_id", "line_no", starts, ends, "pick").select("doc_id", "line_no")


@query(f"select job, seq, score, row_number() over (partition by job, score order by seq % 2, seq) as counter from {RESULTS_SQL}")
def result_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written in two runs, those with even seq first; the second run's counters go on."""
    rows = results(table(spark, sf_dir, "events"))
    path = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"  # a lasting one would be given here
    sinks.write_results(rows.where("seq % 2 = 0"), path)
    return sinks.write_results(rows.where("seq % 2 = 1"), path).select("job", "seq", "score", "counter")


@query("select doc_id, length(text) as score from documents")
def scored_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents scored over two runs; the second one works out only texts that the first, over English ones, has not."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    path = f"{shared_folder(spark)}/memo-{uuid.uuid4().hex}"  # a lasting one would be given here
    score = lambda new: new.select("digest", F.length("source").cast("long").alias("score"))
    sinks.scored_once(docs.where("lang = 'en'"), path, score, "text")
    return sinks.scored_once(docs, path, score, "text").select("doc_id", "score")


# Draws


@query("select l_orderkey, arg_min(l_linenumber, sha256(l_orderkey || ':' || l_linenumber || 'region')) as region from lineitem group by 1")
def region_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of each order's lines, by the least hash."""
    drawn = F.sha2(F.concat(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")), F.lit("region")), 256)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_linenumber", drawn).alias("region"))


def _drawn(limit: int, parts: str) -> str:
    return f"(cast('0x' || substr(sha256({parts}), 1, 15) as bigint) % {limit})"


@query(f"""with w as (select *, lag(score) over (partition by job order by seq) as before from {RESULTS_SQL})
    select job, seq, coalesce({_drawn(10, "seq || 'keep'")} < 6 and before not in (0, {scoring.FAILED}), false) as keeps from w""")
def keep_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a result goes on from the one before it: six times of ten, if that one is neither perfect nor failed."""
    rows = ordered.neighbour(results(table(spark, sf_dir, "events")).select("job", "seq", "score"), "job", "seq", F.col("score"), "before")
    drawn = tables.uniform(F.concat(F.col("seq").cast("string"), F.lit("keep")), F.lit(10)) < 6
    return rows.select("job", "seq", F.coalesce(drawn & ~F.col("before").isin(0, scoring.FAILED), F.lit(False)).alias("keeps"))


@query(f"""select l_orderkey, l_linenumber from lineitem where l_linenumber = 1 or {_drawn(100, "l_orderkey || ':whole'")} < 20
    or ({_drawn(2, "l_orderkey || ':half'")} = 0 and {_drawn(2, "l_orderkey || ':' || l_linenumber || ':row'")} = 0)
    or ({_drawn(100, "l_orderkey || ':side'")} < 20 and case when {_drawn(2, "l_orderkey || ':which'")} = 0 then l_linenumber < 1 else l_linenumber > 1 end)""")
def subset_around_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.around_pivot(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber", F.lit(1), "")


@query(f"""select l_orderkey, arg_min(l_linenumber, -ln(({_drawn(1000000, "l_orderkey || ':' || l_linenumber || 'try'")} + 1) / 1000001.0) / l_quantity) as chosen
    from lineitem where l_returnflag <> 'R' and l_quantity > 0 group by 1""")
def first_applicable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted choice that is tried again until one applies: the least of exponential draws among those that apply."""
    u = tables.uniform(F.concat(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")), F.lit("try")), F.lit(1000000))
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R' and l_quantity > 0")
    return rows.groupBy("l_orderkey").agg(F.min_by("l_linenumber", -F.ln((u + 1) / F.lit(1000001.0)) / F.col("l_quantity")).alias("chosen"))


# Life of jobs


@query("""with d as (select *, case when event_type in ('signup', 'view') then 1 when event_type in ('purchase', 'click') then -1 else 0 end as d from events),
    s as (select *, sum(d) over (partition by user_id order by event_id) as s from d) select event_id from s where d = -1 and s = 0""")
def counted_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results after which no work of their job is out any more."""
    step = F.when(F.col("event_type").isin("signup", "view"), 1).when(F.col("event_type").isin("purchase", "click"), -1).otherwise(0)
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", step.cast("long").alias("d"))
    return ordered.with_running(rows, "user_id", ["event_id"], F.col("d"), "s").where("d = -1 and s = 0").select("event_id")


@query("select event_id from events e left join (select user_id as u, min(event_id) as last from events where event_type = 'purchase' and value < 5 group by 1) r on e.user_id = r.u where last is null or event_id <= last")
def late_results_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows up to the removal of their job; later ones go."""
    events = table(spark, sf_dir, "events")
    removed = events.where("event_type = 'purchase' and value < 5").groupBy(F.col("user_id").alias("u")).agg(F.min("event_id").alias("last"))
    return events.join(removed, events["user_id"] == removed["u"], "left").where("last is null or event_id <= last").select("event_id")


@query("select event_id, cast(g // 1000000 as bigint) as seconds from (select event_id, epoch_us(lead(ts) over (partition by user_id order by ts, event_id)) - epoch_us(ts) as g from events) where g > 50000 * 1000000::bigint")
def silent_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after which their user is silent for more than 50,000 seconds."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", at.alias("at"))
    later = ordered.neighbour(rows, "user_id", ["ts", "event_id"], F.col("at"), "later", forward=True)
    return later.select("event_id", (F.col("later") - F.col("at")).alias("g")).where(F.col("g") > 50000 * 1000000).select("event_id", F.call_function("div", F.col("g"), F.lit(1000000)).alias("seconds"))


@query(ORACLE_SQL["stats_of_known_users"])
def stream_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stats_of_known_users, kept up by a stream."""
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("known")).distinct()
    events = table_stream(spark, sf_dir, "events")
    rows = events.join(known, events["user_id"] == known["known"], "left")
    levels = F.array(*(F.struct(F.lit(a).alias("level"), b.alias("name")) for a, b in (("total", F.lit("")), ("function", F.col("event_type")), ("client", F.col("known").cast("string")))))
    named = rows.select(F.explode(levels).alias("x"), "value").where("x.name is not null").select("x.level", "x.name", "value")
    counted = named.groupBy("level", "name").agg(F.count("*").alias("n"), F.count_if(F.col("value") < 50).alias("improved"), F.count_if(F.col("value") < 5).alias("matched"))
    return run_updates(counted, ["level", "name"], shared_folder(spark))


@query("""with s as (select *, sum(case when event_type in ('signup', 'view') then 1 when event_type = 'purchase' then -1 else 0 end) over (partition by user_id order by event_id) as s from events),
    e as (select *, min(case when s = 0 and event_type in ('purchase', 'error') then event_id end) over (partition by user_id order by event_id rows between current row and unbounded following) as gone from s)
    select distinct user_id as job, gone as seq from e where event_type = 'error' and gone is not null""")
def stream_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors ask for the removal of their user's job, which goes with the first result after which no work is out."""
    events = table_stream(spark, sf_dir, "events")
    step = F.when(F.col("event_type").isin("signup", "view"), 1).when(F.col("event_type") == "purchase", -1).otherwise(0)
    rows = events.select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), step.alias("step"), (F.col("event_type") == "error").alias("ask"))
    return run_available(removals(rows), shared_folder(spark))


@query("""with g as (select user_id, epoch_us(ts) // 1000 as last, lead(epoch_us(ts) // 1000) over (partition by user_id order by ts) as after from events)
    select user_id, last, last + 86400000 as silent from g where after - last > 86400000 or (after is null and last + 86400000 <= (select max(epoch_us(ts) // 1000) from events))""")
def stream_silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that weren't heard for 20 hours and two half periods of two hours more, by event time."""
    return run_available(silences(table_stream(spark, sf_dir, "events"), "user_id", "ts", 20 * 3_600_000, 4 * 3_600_000), shared_folder(spark))


@query("""select o_orderkey as work, count(*) as results from orders join lineitem on o_orderkey = l_orderkey and l_quantity > 10 and l_shipdate >= o_orderdate and l_shipdate <= o_orderdate + interval 120 day group by 1""")
def stream_work_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of each order that came within 120 days, by a join of two streams; results out of time or of no known work are dropped."""
    work = table_stream(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("work"), F.col("o_orderdate").alias("given"))
    done = table_stream(spark, sf_dir, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("work"), F.col("l_shipdate").alias("done"))
    found = run_available(results_of_work(work, done, "120 days"), shared_folder(spark))
    return found.groupBy("work").agg(F.count("*").alias("results"))


# Rows of listings and other texts


@query(rf"""select doc_id, cast(line_no as integer) as line_no, array_to_string(list_transform(regexp_extract_all(line, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), lambda w: case when regexp_full_match(w, '[0-9]{{2,18}}') then '0x' || printf('%x', try_cast(w as bigint)) when regexp_full_match(w, '[0-9]{{19,38}}') then '0x' || lower(to_hex(try_cast(w as hugeint))) else w end), '') as line from {LINES_SQL}""")
def numbers_as_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(table(spark, sf_dir, "documents")).select("doc_id", "line_no", listing.numbers_as_hex(F.col("line")).alias("line"))


@query(rf"""with {ITEM_ROWS_SQL.replace("cast(l_quantity as bigint) as q,", "cast(l_quantity as bigint) as q, cast(l_partkey as varchar) as part,").replace("select key, pos, case", "select key, pos, q, part, case")},
    noted as (select *, case when name = 'jal' then 'R_MIPS_26 f' || part when name = 'lw' and q % 3 = 0 then 'R_MIPS_GPREL16 d' || part when name = 'addiu' and has_symbol then 'R_MIPS_HI16 d' || part end as note from listed),
    cut as (select *, regexp_extract(row, '^(.*[\s,])?([^\s,()]+)([(][^()]*[)])?\s*$', 1) as head, regexp_extract(row, '^(.*[\s,])?([^\s,()]+)([(][^()]*[)])?\s*$', 2) as v, regexp_extract(row, '^(.*[\s,])?([^\s,()]+)([(][^()]*[)])?\s*$', 3) as tail,
        string_split(note, ' ')[2] as sym from noted)
    select key as l_orderkey, 2 * pos as place, case when note is null then row else head || replace(case when note like '%_26 %' then '?' when note like '%HI16%' then '%hi(?)' else '%lo(?)' end, '?', sym || case when v in ('0', 'imm', 'addr') then '' when v like '-%' then v else '+' || v end) || tail end as row,
    note is not null as has_symbol from cut""")
def relocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as listings, some of whose rows are followed by a relocation that names a symbol for their last operand."""
    rows = _item_rows(table(spark, sf_dir, "lineitem")).withColumn("part", F.col("l_partkey").cast("string"))
    named = lambda kind, mark: F.concat(F.lit(kind + "\t" + mark), F.col("part"))
    note = F.when(F.col("name") == "jal", named("R_MIPS_26", "f")).when((F.col("name") == "lw") & (F.col("q") % 3 == 0), named("R_MIPS_GPREL16", "d")).when((F.col("name") == "addiu") & F.col("has_symbol"), named("R_MIPS_HI16", "d"))
    listed = rows.select("l_orderkey", "pos", F.posexplode(F.array_compact(F.array("row", note))).alias("_at", "row")).select("l_orderkey", (2 * F.col("pos") + F.col("_at")).alias("place"), "row")
    return ordered.with_relocations(listed, "l_orderkey", "place", "row", "mips", "R_MIPS_").select("l_orderkey", "place", "row", "has_symbol")


@query(rf"""with {ITEM_ROWS_SQL}, stacked as (select *, case when name in ('addiu', 'lw') and regexp_matches(row, '\bsp\b') then regexp_replace(row, '(,)-?(0x[0-9a-f]+|[0-9]+)([^A-Za-z0-9_]|$)', '\1imm\3', 'g') else row end as r from listed),
    placed as (select *, regexp_replace(r, '[^\s,()]+[(]sp[)]', 'addr(sp)', 'g') as p from stacked)
    select key as l_orderkey, pos, case when name in ('beq', 'jal') then regexp_replace(p, '[^,\s]+\s*$', '<target>') else p end as row from placed""")
def stack_and_branch_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = listing.branch_target_as_one(listing.stack_as_one(F.col("row"), ("addiu", "lw")), ("beq", "jal"))
    return _item_rows(table(spark, sf_dir, "lineitem")).select("l_orderkey", "pos", form.alias("row"))


#: Events as rows of a listing with small data; purchases are relocations.
_small_rows = """rows as (select user_id, event_id, cast(floor(value) as bigint) as v, event_type as t from events),
    forms as (select *, case t when 'view' then 'lis' when 'click' then 'lwz' when 'error' then 'addi' when 'signup' then 'li' else 'R_PPC_EMB_SDA21' end as operation,
        case t when 'view' then 'r3,' || v when 'click' then 'r3,' || v || '(r13)' when 'error' then 'r4,r2,' || v when 'signup' then 'r5,' || v else 'd' || v end as operands from rows)"""


@query(rf"""with {_small_rows}, ahead as (select *, coalesce(lead(operation) over (partition by user_id order by event_id) = 'R_PPC_EMB_SDA21', false) as small from forms),
    zero as (select *, regexp_replace(regexp_replace(operands, '[(]r(2|13)[)]', '(0)'), ',r(2|13),', ',0,') as z from ahead)
    select event_id, case when small and operation in ('li', 'lis') then replace(operation, 'li', 'addi') else operation end as operation,
    case when not small then operands when operation in ('li', 'lis') then string_split(z, ',')[1] || ',0,' || string_split(z, ',')[2] else z end as operands from zero""")
def small_data_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as rows of a listing, some of which a relocation of small data follows."""
    t, v = F.col("event_type"), F.floor("value").cast("long").cast("string")
    cases = {"view": ("lis", "r3,", ""), "click": ("lwz", "r3,", "(r13)"), "error": ("addi", "r4,r2,", ""), "signup": ("li", "r5,", "")}
    operation, operands = F.lit("R_PPC_EMB_SDA21"), F.concat(F.lit("d"), v)
    for name, (op, before, after) in cases.items():
        operation, operands = F.when(t == name, op).otherwise(operation), F.when(t == name, F.concat(F.lit(before), v, F.lit(after))).otherwise(operands)
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", operation.alias("operation"), operands.alias("operands"))
    return ordered.small_data_rows(rows, "user_id", "event_id", "operation", "operands", "operation").select("event_id", "operation", "operands")


@query(r"""with w as (select doc_id, unnest(range(len(ws))) as place, unnest(ws) as word from (select doc_id, regexp_extract_all(text, '[A-Za-z0-9+-]*[0-9][A-Za-z0-9]*') as ws from documents)),
    s as (select *, lower(regexp_replace(word, '^[+-]', '')) as body, case when word like '-%' then -1 else 1 end as sign from w)
    select doc_id, cast(place as integer) as place, word, sign * case when regexp_full_match(body, '0x[0-9a-f]+') then try_cast(body as bigint) when regexp_full_match(body, '0o[0-7]{1,20}') then list_reduce(range(3, length(body) + 1), lambda a, k: a * 8 + try_cast(substr(body, k, 1) as bigint), 0::bigint)
        when regexp_full_match(body, '0b[01]{1,62}') then list_reduce(range(3, length(body) + 1), lambda a, k: a * 2 + try_cast(substr(body, k, 1) as bigint), 0::bigint) when regexp_full_match(body, '0+|[1-9][0-9]*') then try_cast(body as bigint) end as value from s""")
def based_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with a digit in documents, read as whole numbers of any base; null for those that are none."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z0-9+-]*[0-9][A-Za-z0-9]*"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(words).alias("place", "word")).select("doc_id", "place", "word", listing.based_int(F.col("word")).alias("value"))


@query("""select p_partkey, case when regexp_full_match(p_name, '[A-Za-z0-9_@%+=:,./-]+') then p_name else '''' || replace(p_name, '''', '''"''"''') || '''' end as word from part""")
def shell_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", listing.shell_quoted(F.col("p_name")).alias("word"))


@query(r"""with w as (select p_partkey, regexp_replace(p_type, '[^A-Za-z]+', '_', 'g') as a, regexp_replace(p_name, '[^A-Za-z]+', '_', 'g') as b, p_size from part),
    t as (select p_partkey, 'PERM_X(1) {}' || chr(10) || 'int ' || a || '(int x) {' || chr(10) || '  while (x) { if(x) {} }' || chr(10) || '}' || chr(10) || 'void ' || b || '(void)' || case when p_size % 2 = 0 then ';' else chr(10) || '{ for(;;) {} }' end as source from w)
    select p_partkey, list_last(list_filter(regexp_extract_all(source, '(\w+)\([^()]*\)\s*\{', 1), lambda n: n not in ('if', 'for', 'while', 'switch') and not starts_with(n, 'PERM'))) as name from t""")
def function_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C text made of each part's type and name; the second function is defined for odd sizes and declared for even ones."""
    a, b = (F.regexp_replace(c, "[^A-Za-z]+", "_") for c in ("p_type", "p_name"))
    ending = F.when(F.col("p_size") % 2 == 0, ";").otherwise("\n{ for(;;) {} }")
    source = F.concat(F.lit("PERM_X(1) {}\nint "), a, F.lit("(int x) {\n  while (x) { if(x) {} }\n}\nvoid "), b, F.lit("(void)"), ending)
    return table(spark, sf_dir, "part").select("p_partkey", listing.function_name(source).alias("name"))


@query("select page_id, block from (select page_id, unnest(regexp_extract_all(html, '(?s)<script>(.*?)</script>', 1)) as block from pages)")
def embedded_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(listing.blocks(F.col("html"), "<script>", "</script>")).alias("block"))


@query(r"""select event_id, regexp_extract(props, '"(\w+)"', 1) as name, cast(regexp_extract(props, ': *(-?[0-9]+)', 1) as bigint) as value from events where props like '%:%'""")
def store_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored JSON maps, one row an entry."""
    return table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string, long>")).alias("name", "value"))


@query(f"select job, seq, score from {RESULTS_SQL}")
def score_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All results, the worst first."""
    return results(table(spark, sf_dir, "events")).select("job", "seq", "score").orderBy(F.desc("score"), "job", "seq")


@query("select p_partkey, concat_ws(',', case when p_size between 5 and 40 then null else 'p_size' end, case when p_retailprice between 1000 and 1500 then null else 'p_retailprice' end) as outside from part")
def option_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", listing.outside({"p_size": (5, 40), "p_retailprice": (1000, 1500)}).alias("outside"))


@query("select p_partkey, chr(10) || ' a; b;' || chr(10) || (['c', 'd'])[p_partkey % 2 + 1] || chr(10) || p_name || repeat(chr(10), 5) || 'e f' || chr(10) as variant from part")
def finished_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's variant of a text with a same-line region, a literal and pretended code, and its name as a further line."""
    head, tail = macros.parsed("PERM_FORCE_SAMELINE(a;\n b;)PERM_GENERAL(c,d)"), macros.parsed("PERM_PRETEND(g)PERM_IGNORE(e f)")
    seed = F.col("p_partkey")
    text = F.concat(head.decode(seed % head.size, {}), F.lit("\n"), F.col("p_name"), tail.decode(F.lit(0), {}))
    return macros.finished(table(spark, sf_dir, "part").select("p_partkey", text.alias("variant")), "p_partkey")


@query(f"with recursive {_first_word} select key as doc_id, tag, i1, i2, j1, j2 from steps")
def align_opcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scoring.opcodes(docs, _target(docs))


@query(f"with recursive {_whole} select key as doc_id, '+' as sign, i as line_no from more union all select key, '-', j from less")
def line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scoring.line_diff(docs, _target(docs))
