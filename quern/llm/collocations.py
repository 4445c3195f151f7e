"""Phrase collocations: count-min sketches first, exact counts of their survivors second, then scores and subsumption.

Words are lower-cased (A-Z) and stand in pieces, which phrases don't cross. Every task counts the phrases of 1 to `longest`
words by sections of about a quarter of a million words and sends their counts as cells of a sketch with DEPTH rows; the partial sketches
are added up, range by range, and of each cell one bit is kept: whether it reaches `least`. A sketch never counts too little, so
a phrase with a cell below the mark can't be frequent. The second pass counts only phrases all of whose cells are set, this time by
their words, and drops what the sketch overestimated; so nothing frequent is lost whatever the width. Parts of a frequent phrase are at
least as frequent, so the exact counts hold all that scores need.

The width follows the bytes of all texts up to 2**MOST_BITS cells, so the bits that are broadcast have at most DEPTH *
2**MOST_BITS / 8 bytes (64 MB). A corpus for which that is too narrow has more survivors to count, not other results.

Defined cases: a null or empty text has no words; a null lang counts as `und`; repeated rows count as often as they come; an
empty table gives an empty result; columns other than text and lang, whatever their names, are not read; a word is a run of any
bytes but white space and marks, of any length. Counts up to 10**15 are scored exactly, larger ones are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import partitions, read, stored

LONGEST, LEAST, SHARE, TOP = 3, 10, 50, 2000
DEPTH, LEAST_BITS, MOST_BITS = 2, 16, 28
#: Ranges of cells that are merged one by one, words of a section, bytes of a text that are cut into words at a time.
RANGES, SECTION, SLICE = 1024, 1 << 18, 1 << 22
#: Marks that end a piece turn to a byte that UTF-8 never has; tabs to spaces; A-Z to a-z.
MARK = b"\xff"
TABLE = bytes(255 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Section:
    """Words of one language in their order, with MARK between pieces; `carried` are ranges that the section before has counted."""

    def __init__(self) -> None:
        self.words: list[bytes] = []
        self.carried: list[tuple[int, int]] = []


def sections(batches: Iterator[pa.RecordBatch], longest: int, limit: int = SECTION, cut: int = SLICE) -> Iterator[dict[str, Section]]:
    """Sections by language, about `limit` words together. A text that goes on in the next section takes its last words along."""
    held: dict[str, Section] = {}
    n = 0
    for batch in batches:
        for lang, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = data.as_py().translate(TABLE).replace(MARK, b" \xff ")
            at, kept = 0, []
            while at < len(text):
                end = text.find(b" ", at + cut)
                end = len(text) if end < 0 else end
                new = text[at:end].split()
                section = held.setdefault(lang, Section())
                section.words.append(MARK)
                section.carried.append((len(section.words), len(section.words) + len(kept)))
                section.words += kept
                section.words += new
                kept = (kept + new)[1 - longest :] if longest > 1 else []
                at, n = end, n + len(new)
                if n >= limit:
                    yield held
                    held, n = {}, 0
    if held:
        yield held


def phrases(section: Section, longest: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, list[bytes]]]:
    """By length: (numbers of the words of each different phrase, by place; its count; the words that the numbers mean)."""
    vocabulary = {MARK: 0}
    ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in section.words], np.int64)
    words, base = list(vocabulary), len(vocabulary)
    own = np.ones(len(ids), bool)
    for a, b in section.carried:
        own[a:b] = False
    rank = np.where(ids > 0, 0, -1)
    for size in range(1, longest + 1):
        n = len(ids) - size + 1
        if n <= 0:
            return
        last = ids[size - 1 :]
        whole = (rank[:n] >= 0) & (last > 0)
        code = rank[:n] * base + last
        _, first, inverse = np.unique(code[whole], return_index=True, return_inverse=True)
        counts = np.bincount(inverse[own[size - 1 :][whole]], minlength=len(first))
        rank = np.full(n, -1)
        rank[whole] = inverse
        at = np.flatnonzero(whole)[first[counts > 0]]
        yield [ids[at + k] for k in range(size)], counts[counts > 0], words


def hashes(text: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(t, digest_size=8).digest() for t in text), "<u8")


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def cells(lang: str, numbers: list[np.ndarray], word_hashes: np.ndarray, bits: int) -> np.ndarray:
    """The cell of each phrase in each row of the sketch; the rows lie one after the other."""
    h = np.full(len(numbers[0]), hashes([lang.encode()])[0])
    for k in numbers:
        h = mixed(h ^ word_hashes[k])
    rows = [mixed(h + np.uint64(r + 1)) >> np.uint64(64 - bits) for r in range(DEPTH)]
    return np.stack([row + np.uint64(r << bits) for r, row in enumerate(rows)])


def sketch(rows: DataFrame, longest: int, least: int, bits: int, limit: int = SECTION, cut: int = SLICE) -> np.ndarray:
    """One bit for each cell of the merged sketch of rows(lang, text as bytes): whether it counts `least` or more."""

    width = (DEPTH << bits) // RANGES

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in sections(batches, longest, limit, cut):
            found = []
            for lang, section in held.items():
                word_hashes = None
                for numbers, counts, words in phrases(section, longest):
                    word_hashes = hashes(words) if word_hashes is None else word_hashes
                    at = cells(lang, numbers, word_hashes, bits)
                    found.append((at << np.uint64(8) | np.minimum(counts, 255).astype(np.uint64)).ravel())
            if found:
                packed = np.sort(np.concatenate(found))
                own = (packed >> np.uint64(8)) // np.uint64(width)
                starts = np.searchsorted(own, np.arange(RANGES + 1, dtype=np.uint64)).tolist()
                inside = (packed - ((own * np.uint64(width)) << np.uint64(8))).astype("<u4")  # place in the range, count
                there = [k for k in range(RANGES) if starts[k] < starts[k + 1]]
                yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array([inside[starts[k] : starts[k + 1]].tobytes() for k in there])], ["chunk", "cells"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by chunk; one chunk and some of its parts are held at a time."""

        def added(total: np.ndarray, parts: list[bytes]) -> np.ndarray:
            found = np.frombuffer(b"".join(parts), "<u4")
            return np.minimum(total + np.bincount(found >> 8, found & 255, width).astype(np.int64), 1 << 20)

        def out(chunk: int, total: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.packbits(total >= least).tobytes()])], ["chunk", "bits"])

        now, total, parts, n = None, None, [], 0
        for batch in batches:
            for chunk, part in zip(*(c.to_pylist() for c in batch.columns)):
                if chunk != now or n > 4 * width + (1 << 22):
                    total = added(total, parts) if parts else total
                    if chunk != now:
                        if now is not None:
                            yield out(now, total)
                        now, total = chunk, np.zeros(width, np.int64)
                    parts, n = [], 0
                parts.append(part)
                n += len(part)
        if now is not None:
            yield out(now, added(total, parts))

    sent = rows.mapInArrow(partial, "chunk int, cells binary").repartition(partitions(rows.sparkSession), "chunk")
    held = sent.sortWithinPartitions("chunk").mapInArrow(merged, "chunk int, bits binary").toArrow()  # at most DEPTH * 2**bits / 8 bytes
    bitmap = np.zeros(DEPTH << bits >> 3, np.uint8)
    for chunk, found in zip(held["chunk"].to_pylist(), held["bits"].to_pylist()):
        bitmap[chunk * width // 8 : (chunk + 1) * width // 8] = np.frombuffer(found, np.uint8)
    return bitmap


def frequent(rows: DataFrame, longest: int = LONGEST, least: int = LEAST, bits: int | None = None, limit: int = SECTION, cut: int = SLICE) -> DataFrame:
    """(lang, size, phrase, n) of rows(lang, text): exact counts of phrases of 1 to `longest` words that occur `least` times or more;
    rows of size 0 hold the number of words of each language. It is written to the shared folder."""
    texts = rows.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text")).where(F.octet_length("text") > 0)
    if bits is None:
        total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = max(LEAST_BITS, min(MOST_BITS, (total // 4).bit_length()))
    bitmap = rows.sparkSession.sparkContext.broadcast(sketch(texts, longest, least, bits, limit, cut))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in sections(batches, longest, limit, cut):
            for lang, section in held.items():
                word_hashes = None
                for numbers, counts, words in phrases(section, longest):
                    if word_hashes is None:
                        word_hashes, named = hashes(words), np.array(words, object)
                        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([0], pa.int32()), pa.array([b""]), pa.array([int(counts.sum())])], names)
                    at = cells(lang, numbers, word_hashes, bits)
                    set_ = (bitmap.value[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8) & 1).all(0)
                    chosen = np.flatnonzero(set_)
                    for k in range(0, len(chosen), 1 << 16):
                        some = chosen[k : k + (1 << 16)]
                        text = [b" ".join(p) for p in zip(*(named[x[some]].tolist() for x in numbers))]
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(np.full(len(some), len(numbers), np.int32)), pa.array(text), pa.array(counts[some].astype(np.int64))], names)

    names = ["lang", "size", "phrase", "n"]
    counted = texts.mapInArrow(exact, "lang string, size int, phrase binary, n long").groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    return stored(counted.where((F.col("size") == 0) | (F.col("n") >= least)).withColumn("phrase", F.col("phrase").cast("string")))


def wide(c: str) -> Column:
    return F.col(c).cast("decimal(16,0)")


def scored(counts: DataFrame, longest: int = LONGEST, share: int = SHARE) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates among counts(lang, size, phrase, n) that no longer one holds to `share` percent."""
    candidates = counts.where("size >= 2").select("lang", "size", "phrase", F.col("n").alias("a"))
    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))
    longer = candidates.where("size >= 3").select("lang", F.col("a").alias("_a"), F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("_a").alias("_a"))
    left = candidates.join(longer, ["lang", "phrase"], "left").where(F.col("_a").isNull() | (100 * wide("_a") < share * wide("a"))).drop("_a")
    cut = left.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).withColumn("_first", F.expr("substring_index(phrase, ' ', k)"))
    cut = cut.withColumn("_rest", F.expr("substring(phrase, length(_first) + 2)"))
    for part, name in (("_first", "l"), ("_rest", "r")):
        own = counts.where("size >= 1").select("lang", F.col("phrase").alias(part), F.col("n").alias(name))
        cut = cut.join(own, ["lang", part])
    score = F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * (wide("a") * wide("a")), wide("l") * wide("r"))
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x")
    return cut.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "x.l", "x.r", "x.score")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, share: int = SHARE, top: int = TOP, bits: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: the first `top` of each language by score, count and phrase."""
    counts = frequent(docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")), longest, least, bits)
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    part = scored(counts, longest, share).withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = part.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_rank") <= top)  # leaves at most 64 * top a language
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    words = counts.where("size = 0").select("lang", F.col("n"))
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("int").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


COLLOCATIONS_SQL = f"""with d as (select row_number() over () as d, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select d, lang, unnest(range(len(ps))) as p, unnest(ps) as t from (select d, lang, regexp_split_to_array(t, '[.,;:!?\\n\\x0b\\f\\r]') as ps from d)),
w as (select lang, list_filter(regexp_split_to_array(t, '[ \\t]+'), lambda x: x <> '') as w from p),
g as (select lang, k as size, array_to_string(w[i:i + k - 1], ' ') as phrase from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from w, range(1, {LONGEST + 1}) r(k) where len(w) >= k)),
f as (select lang, size, phrase, count(*) as n from g group by 1, 2, 3 having count(*) >= {LEAST}),
n as (select lang, count(*) as n from g where size = 1 group by 1),
c as (select *, string_split(phrase, ' ') as w from f where size >= 2),
inside as (select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, max(n) as longer from (select lang, w, n, m, unnest(range(1, size - m + 2)) as i from c, range(2, {LONGEST}) r(m) where m < size) group by 1, 2),
kept as (select c.* from c left join inside i on c.lang = i.lang and c.phrase = i.phrase where longer is null or 100 * longer < {SHARE} * c.n),
cut as (select c.lang, c.phrase, c.n as a, k, x.n as l, y.n as r, 1000000 * c.n::hugeint * c.n // (x.n::hugeint * y.n) as score from kept c, range(1, {LONGEST}) t(k), f x, f y
    where k < c.size and x.lang = c.lang and y.lang = c.lang and x.phrase = array_to_string(w[1:k], ' ') and y.phrase = array_to_string(w[k + 1:], ' ')),
low as (select * from cut qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, rank, phrase, a, l, r, n, cast(score as bigint) as score from (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from low) join n using (lang) where rank <= {TOP}"""

QUERIES = {"op11_collocations": op11_collocations}
ORACLE_SQL = {"op11_collocations": COLLOCATIONS_SQL}
