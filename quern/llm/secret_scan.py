"""Secret scans over an incremental ledger of content-addressed blobs, with DataFrame functions only.

Every text is a version of the path (key) that holds it; its blob address is its SHA-256. A scan takes the blobs for which
the ledger has no entry at the present rule version, reads each from the first path that holds it, scans it once, and joins
the findings back to all paths. The ledger then has these blobs too, so a later call scans only what is new.

Rules (kinds), each leftmost and non-overlapping, in this order where spans start together:
assign: a password-like name, ':' or '=', and a value of 8 or more characters; access: AKIA with 16 or more characters in
all; hex: 32 or more lowercase hexadecimal digits; and beyond these three: pem (the head line of a private key), github
(gh?_ tokens), slack (xox?- tokens), jwt (three base64url parts of which two begin with eyJ).

Defined cases: a null text is empty; an empty text has no findings; repeated rows each give a row; an empty table gives an
empty result; other columns are not read. Paths may be null or shared: a text whose rows all have a null key is scanned like
any other.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import let, read, shared_folder, stored, text_or_empty

VERSION = 1
_NAME = r"(password|passwd|secret|token|api_?key)"
_ASSIGN = _NAME + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_VALUE = f"(?i:{_NAME[:-1]}))" + _ASSIGN[len(_NAME) :]
#: kind: (pattern, pattern that a match must contain: of assign, 8 characters of the value itself)
RULES = {
    "assign": (_VALUE, "^" + _VALUE.removesuffix("+)") + "{8})"),
    "access": (r"AKIA[A-Z0-9]{12,}", None),
    "hex": (r"[0-9a-f]{32,}", None),
    "pem": (r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", None),
    "github": (r"gh[oprsu]_[A-Za-z0-9]{36,}", None),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}", None),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", None),
}
BASE = ("assign", "access", "hex")


FINDINGS = "array<struct<start:int,ord:int,kind:string,end:int,byte_start:int,byte_upto:int,opens:boolean>>"


def matches(text: Column, kind: str, order: int) -> Column:
    """array<struct> of a rule's matches in their order: what stands before a match, and the match, in code points and bytes."""
    pattern, must = RULES[kind]

    def step(between: Column, m: Column) -> Column:
        sizes = [f(x).alias(c) for x, c, f in ((between, "gap", F.length), (m, "n", F.length), (between, "byte_gap", F.octet_length), (m, "byte_n", F.octet_length))]
        return F.struct(F.lit(order).alias("ord"), F.lit(kind).alias("kind"), *sizes, (m.rlike(must) if must else F.lit(True)).alias("ok"))

    found = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), step)
    numbered = F.transform(F.filter(found, lambda x: x["n"].isNotNull()), lambda x, i: F.struct(i.alias("pos"), x.alias("x")))
    none = F.expr("cast(array() as array<struct<pos:int,x:struct<ord:int,kind:string,gap:int,n:int,byte_gap:int,byte_n:int,ok:boolean>>>)")
    return F.when(text.rlike(pattern), numbered).otherwise(none)


def scan(blobs: DataFrame) -> DataFrame:
    """(blob, findings) of blobs(blob, text), once for each blob: findings is sorted, and holds start, ord, kind and end of each
    span in code points; besides, where it starts in bytes, how far it and those before it reach, and whether none before reaches it.

    Places are running sums over the matches of a rule, so the work grows with the number of matches.
    """
    parts = [matches(F.col("text"), kind, k) for k, kind in enumerate(RULES)]
    rows = blobs.select("blob", F.explode_outer(F.concat(*parts)).alias("m")).select("blob", "m.pos", "m.x.*")
    rows = rows.repartition("blob").dropDuplicates(["blob", "ord", "pos"])
    so_far = Window.partitionBy("blob", "ord").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"end": F.sum(F.col("gap") + F.col("n")).over(so_far).cast("int"), "byte_end": F.sum(F.col("byte_gap") + F.col("byte_n")).over(so_far).cast("int")})
    rows = rows.withColumn("start", F.col("end") - F.col("n"))
    before = Window.partitionBy("blob").orderBy("start", "ord").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("blob").orderBy("start", "ord").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.col("start") >= F.coalesce(F.max(F.when(F.col("ok"), F.col("end"))).over(before), F.lit(0))
    rows = rows.withColumns({"opens": opens, "byte_upto": F.max(F.when(F.col("ok"), F.col("byte_end"))).over(upto)})
    span = F.struct("start", "ord", "kind", "end", (F.col("byte_end") - F.col("byte_n")).alias("byte_start"), "byte_upto", "opens")
    return rows.groupBy("blob").agg(F.sort_array(F.collect_list(F.when(F.col("ok"), span))).cast(FINDINGS).alias("findings"))


def unseen(versions: DataFrame, ledger: DataFrame | None, version: int) -> DataFrame:
    """(blob, text) of the blobs in versions(key, blob, text) that the ledger lacks at this rule version."""
    new = versions.groupBy("blob").agg(F.min("key").alias("key"))
    if ledger is not None:
        new = new.join(ledger.where(F.col("version") == version).select("blob"), "blob", "left_anti")
    first = new.select(F.col("key").alias("_key"), F.col("blob").alias("_blob")).hint("shuffle_hash")
    return versions.join(first, versions.key.eqNullSafe(first._key) & (versions.blob == first._blob), "left_semi").select("blob", "text")


def versions_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))


def paths(versions: DataFrame, ledger: DataFrame, version: int, key: str) -> DataFrame:
    """key, blob and findings of every version, from the ledger's entries."""
    hits = ledger.where((F.col("version") == version) & (F.size("findings") > 0)).select("blob", "findings")
    found = versions.select(F.col("key").alias(key), "blob").join(hits, "blob", "left")
    return found.withColumn("findings", F.coalesce("findings", F.expr(f"cast(array() as {FINDINGS})")))


def secret_scan(docs: DataFrame, ledger: DataFrame | None = None, version: int = VERSION, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(found, ledger): key, blob and findings for each row of docs, and the ledger(blob, version, findings) after the scan."""
    versions = versions_of(docs, key, text)
    new = stored(scan(unseen(versions, ledger, version)).select("blob", F.lit(version).alias("version"), "findings"))
    after = new if ledger is None else ledger.select("blob", "version", "findings").union(new)
    return paths(versions, after, version, key), after


def scan_into(docs: DataFrame, path: str, version: int = VERSION, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, blob and findings for each row of docs; the ledger is a Parquet table at path, to which only new entries are added.

    Each call adds one part (a folder of its own), so that a part is whole or absent.
    """
    spark, versions = docs.sparkSession, versions_of(docs, key, text)
    kinds = f"blob binary, version int, findings {FINDINGS}"
    parts = f"{path}/*.part"
    try:
        ledger = spark.read.schema(kinds).parquet(parts)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        ledger = None
    new = scan(unseen(versions, ledger, version)).select("blob", F.lit(version).alias("version"), "findings")
    new.write.parquet(f"{path}/{uuid.uuid4().hex}.part")
    return paths(versions, spark.read.schema(kinds).parquet(parts), version, key)


def joined(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, findings: Column, mark: str = "[SECRET]") -> Column:
    """text with each maximal run of overlapping spans replaced by mark. Pieces are cut by bytes, so the work is linear."""

    def cut(x: Column) -> Column:
        found = x["found"]
        starts = F.transform(F.filter(found, lambda s: s["opens"]), lambda s: s["byte_start"])
        ends = F.transform(F.filter(found, lambda s, i: F.coalesce(F.get(found, i + 1)["opens"], F.lit(True))), lambda s: s["byte_upto"])
        return let(F.struct(x["bytes"].alias("bytes"), starts.alias("starts"), ends.alias("ends")), pieces)

    def pieces(x: Column) -> Column:
        since = lambda j: F.coalesce(F.get(x["ends"], j - 1), F.lit(0))
        upto = lambda j: F.coalesce(F.get(x["starts"], j), F.length(x["bytes"]))
        kept = F.transform(F.sequence(F.lit(0), F.size(x["starts"])), lambda j: F.substring(x["bytes"], since(j) + 1, upto(j) - since(j)).cast("string"))
        return F.array_join(kept, mark)

    return F.when(F.size(findings) > 0, let(F.struct(text.cast("binary").alias("bytes"), findings.alias("found")), cut)).otherwise(text)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"  # a lasting one would be given here
    found = scan_into(read(spark, sf_dir, "documents"), ledger)

    def of(kind: str) -> Column:
        return F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("findings", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(of, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))


def _sql_spans(kind: str, order: int) -> str:
    pattern, must = (p and p.replace("'", "''") for p in RULES[kind])
    return f"""select doc_id, text, {order} as ord, '{kind}' as kind, m, pre, gap from (select doc_id, text, unnest(regexp_extract_all(text, '{pattern}')) as m, unnest(range(len(regexp_extract_all(text, '{pattern}')))) as k,
        list_transform(regexp_extract_all(text, '{pattern}'), lambda y: length(y)) as ms, list_transform(regexp_split_to_array(text, '{pattern}'), lambda y: length(y)) as gs from secret_docs where regexp_matches(text, '{pattern}')),
        lateral (select coalesce(list_sum(ms[1:k]), 0) as pre, list_sum(gs[1:k + 1]) as gap)""" + (f" where regexp_matches(m, '{must}')" if must else "")


SECRET_SQL = "secret_docs as (select distinct doc_id, coalesce(text, '') as text from {docs}),\nsecret_spans as (select doc_id, text, ord, kind, cast(pre + gap as bigint) as s, cast(pre + gap + length(m) as bigint) as e from (" + "\nunion all ".join(_sql_spans(k, i).replace("{", "{{").replace("}", "}}") for i, k in enumerate(RULES)) + ")),\n" + """
secret_found as (select doc_id, text, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, ord) filter (ord < 3), '') as base, string_agg(kind || ':' || s || ':' || e, ',' order by s, ord) as spans from secret_spans group by doc_id, text)
"""

QUERIES = {"op8_secret_scan": op8_secret_scan}
ORACLE_SQL = {
    "op8_secret_scan": "with " + SECRET_SQL.format(docs="documents") + """select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
    from documents d left join secret_found f on d.doc_id is not distinct from f.doc_id and coalesce(d.text, '') = f.text"""
}
