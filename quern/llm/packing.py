"""Best-fit packing of tokenized documents into sequences of a fixed capacity, in bulk-synchronous sweeps.

1. Texts become token ids in the tasks that read them; a document longer than the capacity is cut into full pieces, with
   the shorter rest in front. What goes on is a small row for each piece.
2. Pieces get a rank among those of their length (from counts by length and salt, so that a length that a third of all pieces
   share is still spread over all tasks), and are range-sorted by length and rank.
3. A superstep takes the longest pieces that are left, down to 5/7 of the longest, and the gaps that may hold them; a gap that
   holds several has several slots. Both are sorted by size, and a sweep from the largest down gives each piece its successor,
   the smallest slot that is left among those that are large enough: a slot raises a level, a piece lowers it, and a piece goes
   to the last slot that reached its level. Levels come from counts by size (as many rows as the capacity at most) and ranks
   inside a size, so tasks match pieces to slots level by level. Where pieces want the same slots, lower ranks win.
4. Pieces that the gaps leave open new sequences, as many as their sum fills or their number needs, which are slots of the same sweep. Gaps are updated
   and the next superstep follows, until no piece is left. Pieces over half the capacity need no sweep: they open a sequence each.

The driver sees the numbers of gaps by size and salt, at most (capacity + 1) x SALTS, and turns them to levels by size; which
piece meets which gap is found by tasks. Every superstep's table is written, so that a lost executor costs one at most. What tasks
need by size stands in their expressions, so that a superstep broadcasts one table at most: the driver would keep them all.

Defined cases: a null text is empty, and an empty one is the end id alone; repeated rows, and rows with null or equal keys,
are packed as documents of their own; runs of white space of any length are encoded like any other text; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import partitions, read, stored, text_or_empty, tokenizer_path

CAPACITY, END_ID = 1024, 2
#: How the byte-level vocabulary format cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space that a cut would need too deep a stack for. (Python's \\s has four characters more than the format's.)
LONG_SPACE = re.compile(r"[^\S\x1c-\x1f]{4096,}")
#: A superstep goes down to 5/7 of the longest piece, or to the shortest if that one is no longer than this part of the capacity.
SMALL = 16
#: Parts that the rows of one size are dealt to when they are ranked.
SALTS = 64


def byte_letters() -> dict[str, int]:
    """The vocabulary file's letter for each byte: itself where it is printable, else the next free one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoding(path: str):
    """The byte-level vocabulary of a tokenizers file as ranks. Raises ValueError if its merges are not in the order of its ids."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, special = byte_letters(), {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    if any(vocab[a + b] != 256 + i for i, (a, b) in enumerate(merges)) or len(vocab) != 256 + len(merges):
        raise ValueError("the ids are not in the order of the merges")
    ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(encoder, text: str) -> np.ndarray:
    """The ids of a text; special strings inside it become their ids."""
    out, at = [], 0
    for run in LONG_SPACE.finditer(text):
        a, b = run.span()
        if b < len(text) and not any(text.startswith(s, b) for s in encoder.special_tokens_set):
            b -= 1  # the last one belongs to what follows
        out += [encoder.encode_to_numpy(text[at:a], allowed_special="all"), np.array(encoder._core_bpe.encode_single_piece(text[a:b].encode()), np.uint32)]
        at = b
    return np.concatenate([*out, encoder.encode_to_numpy(text[at:], allowed_special="all")])


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length and ids_crc32 (and ids) of each piece of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(path)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part, rows, out_ids = batch.slice(at, 512), [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    ids = np.append(token_ids(encoder, t), np.uint32(END_ID)).astype("<u4")
                    cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
                    rows += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                    out_ids += [ids[a:b] for a, b in zip(cuts, cuts[1:])] if with_ids else []
                of, *columns = (pa.array(c, pa.int64()) for c in zip(*rows))
                columns = [part.column(0).take(of), columns[0].cast(pa.int32()), *columns[1:]]
                names = ["key", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array([x.tolist() for x in out_ids], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text")).mapInArrow(run, schema)


def salted(df: DataFrame, *order: str) -> DataFrame:
    return df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)).cast("int"))


def ranked(df: DataFrame, size: str, counts: np.ndarray, *order: str) -> DataFrame:
    """df with rank, from 0, among the rows of its size; counts[size, salt] has their numbers."""
    before = np.cumsum(counts, axis=1) - counts
    at = np.nonzero(counts)
    offsets = df.sparkSession.createDataFrame(pa.table([pa.array(at[0] * SALTS + at[1]), pa.array(before[at])], ["_at", "_before"]))
    inside = F.row_number().over(Window.partitionBy(size, "_salt").orderBy(*order)) - 1
    found = salted(df, *order).withColumn("_in", inside)
    found = found.join(F.broadcast(offsets), F.col(size) * SALTS + F.col("_salt") == F.col("_at"))
    return found.withColumn("rank", F.col("_in") + F.col("_before")).drop("_at", "_salt", "_in", "_before")


def by_size(values: np.ndarray, size: str) -> Column:
    """values[size], from a constant in the expression."""
    constant = F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast("array<long>")
    return F.element_at(constant, (F.col(size) + 1).cast("int"))


def counted(df: DataFrame, size: str, capacity: int, *order: str) -> np.ndarray:
    """How many rows there are of each size and salt: (capacity + 1) x SALTS numbers at most, however large df is."""
    rows = salted(df, *order).groupBy(size, "_salt").agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros((capacity + 1, SALTS), np.int64)
    counts[rows[size].to_numpy(), rows["_salt"].to_numpy()] = rows["n"].to_numpy()
    return counts


def levels(slots: np.ndarray, wants: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(level, floor) by size, for numbers of slots and pieces by size: level is what larger slots and pieces leave; of the slots
    of a size those above floor are taken sooner or later."""
    upto = np.cumsum((slots - wants)[::-1])
    least = np.minimum(np.append(0, np.minimum.accumulate(upto)[:-1]), 0)
    level = (upto - least)[::-1] - slots + wants
    after = np.maximum(level + slots - wants, 0)
    return level, np.minimum.accumulate(after)


def sweep(runs: DataFrame, gaps: DataFrame, level: np.ndarray, floor: np.ndarray, done: np.ndarray, room: np.ndarray, low: int, top: int, capacity: int) -> DataFrame:
    """The gaps(sequence, gap) after a superstep, and its moves (length, rank, sequence, offset; gap is null in these rows).

    runs(length, rank) are all pieces, gaps have ranks; level, floor, done and room are by size.
    """
    pieces_ = runs.where((F.col("length") > low) & (F.col("length") <= top)).withColumn("_done", by_size(done, "length"))
    at = by_size(room, "length") - (F.col("rank") - F.col("_done"))
    pieces_ = pieces_.where(F.col("rank") >= F.col("_done")).withColumn("at", at).where("at > 0")
    pieces_ = pieces_.select("at", F.col("length").alias("size"), F.lit(1).alias("kind"), "rank", F.lit(None).cast("long").alias("sequence"))
    slots = gaps.where(F.col("gap") > low).withColumns({"_level": by_size(level, "gap"), "per": F.greatest(F.lit(1).cast("long"), F.floor(F.col("gap") / top))})
    first, last = F.greatest(F.col("_level") + F.col("rank") * F.col("per"), by_size(floor, "gap")) + 1, F.col("_level") + (F.col("rank") + 1) * F.col("per")
    slots = slots.withColumns({"first": first, "last": last}).where("first <= last")
    slots = slots.select(F.explode(F.sequence("first", "last")).alias("at"), F.col("gap").alias("size"), F.lit(0).alias("kind"), "rank", "sequence")
    its = F.lag("sequence").over(Window.partitionBy("at").orderBy(F.desc("size"), "kind"))
    moved = slots.union(pieces_).withColumn("its", its).where("kind = 1").select(F.col("its").alias("sequence"), F.lit(None).cast("long").alias("gap"), "at", "size", "rank")
    none = F.lit(None).cast("long")
    of_sequence = Window.partitionBy("sequence").orderBy("at")
    both = gaps.select("sequence", "gap", F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("size"), none.alias("rank")).union(moved)
    both = both.withColumns({"_gap": F.first("gap").over(of_sequence), "_upto": F.sum("size").over(of_sequence), "_all": F.sum("size").over(Window.partitionBy("sequence"))})
    is_move = F.col("gap").isNull()
    return stored(both.select("sequence", (F.col("gap") - F.col("_all")).alias("gap"), F.when(is_move, F.col("size")).alias("length"), "rank", F.when(is_move, capacity - F.col("_gap") + F.col("_upto") - F.col("size")).alias("offset")))


def best_fit(runs: DataFrame, number: np.ndarray, capacity: int) -> DataFrame:
    """(length, rank, sequence, offset) for each of the stored runs(length, rank), of which there are number[length]."""
    spark = runs.sparkSession
    size, half = np.arange(capacity + 1), capacity // 2
    # Longer ones than half the capacity take a sequence each, in the order of lengths.
    opened = int(number[half + 1 :].sum())
    sequence = by_size(np.cumsum(np.where(size > half, number, 0)) - number, "length") + F.col("rank")
    alone = runs.where(F.col("length") > half).select(sequence.alias("sequence"), (capacity - F.col("length")).alias("gap"), "length", "rank", F.lit(0).cast("long").alias("offset"))
    now = alone
    moves = [alone.select("length", "rank", "sequence", "offset")]
    done = np.where(size > half, number, 0)
    while (done < number).any():
        top = int(size[done < number][-1])
        low = top * 5 // 7 if top > capacity // SMALL else 0
        gaps = now.where("gap > 0").select("sequence", "gap")
        counts = counted(gaps, "gap", capacity, "sequence")
        per = np.maximum(1, size // top)
        slots, wants = np.where(size > low, counts.sum(1) * per, 0), np.where((size > low) & (size <= top), number - done, 0)
        level, _ = levels(slots, wants)
        rest = int(((wants - np.clip(level + slots, 0, wants)) * size).sum())
        # Whatever meets what, a gap takes no more than so many of the shortest.
        least = int(size[wants > 0][0])
        beyond = int(wants.sum() - (counts.sum(1) * (size // least)).sum())
        fresh = max(1, rest // capacity, -(-beyond // (capacity // least))) if rest else 0
        slots[capacity] += fresh * per[capacity]
        level, floor = levels(slots, wants)
        met = np.clip(level + slots, 0, wants)
        more = spark.range(opened, opened + fresh).select(F.col("id").alias("sequence"), F.lit(capacity).cast("long").alias("gap"), (F.col("id") + int(counts[capacity].sum()) - opened).alias("rank"))
        all_ = ranked(gaps, "gap", counts, "sequence").select("sequence", "gap", "rank").union(more) if counts.any() else more
        now = sweep(runs, all_, level, floor, done, level + slots, low, top, capacity)
        moves.append(now.where("length is not null").select("length", "rank", "sequence", "offset"))
        done, opened = done + met, opened + fresh
    out = moves[0]
    for m in moves[1:]:
        out = out.union(m)
    return out


def placed(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows(key, piece, length, ids_crc32, ...) with sequence_id and offset. rows are read twice, so they should be stored."""
    order = ("key", "piece", "ids_crc32")
    counts = counted(rows, "length", capacity, *order)
    runs = stored(ranked(rows, "length", counts, *order).repartitionByRange(partitions(rows.sparkSession), "length", "rank"))
    moves = best_fit(runs.select("length", "rank"), counts.sum(1), capacity)
    found = runs.join(moves.withColumnRenamed("sequence", "sequence_id"), ["length", "rank"])
    return found.select(*rows.columns, "sequence_id", "offset")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id and offset (and ids) of each piece."""
    return placed(stored(pieces(docs, path, capacity, with_ids, key, text)), capacity).withColumnRenamed("key", key)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


QUERIES = {"op2_best_fit_packing": op2_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
