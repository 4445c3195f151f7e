"""SimHash near-duplicates with a hierarchical index in Gray order.

1. A fingerprint for each document, in the tasks that read it.
2. Index. Codes are sorted several times, each time with other bits in front (`bit_orders`) and by Gray rank, so that codes
   that agree in the leading bits lie side by side, and so do codes that share further bits. The sorted list is dealt to
   range partitions and cut there into nodes of a bounded size, between runs of equal leading bits where that is possible.
3. A node is the root of a tree: each of its nodes takes out the masked bit pattern that all codes below it share and that no
   node above has taken. A search adds up the differences on its way down and drops whole groups above `distance`.
4. A run that is cut (by its size, or by a partition's end) goes on in other nodes: its parts are joined by their leading
   bits, pairs of parts whose shared patterns differ too much are pruned before their codes move, and the others are searched.
   So no task holds more than two nodes, however many codes are alike.
5. A pair belongs to the first order that joins it. Each node gives a spanning forest of its own links, nearest ones first (or
   several, without common links), no pairs of whole cliques; `components` joins forests.

Up to three bits, any two codes within `distance` surely meet. Wider searches (`near_texts`: five words, Jaccard similarity of
4/5) choose leading bits at random, so many that codes with 3/5 of `distance` bits between them meet with a chance of RECALL;
their links are candidates if a second fingerprint is near as well, and count after a check of the whole shingle sets. What they
leave apart is searched exactly: texts that are similar enough share one of their rarest shingles (`prefixes`).

Defined cases: a null or empty text, or one without words, has fingerprint 0 and links like any other; repeated rows have
equal fingerprints and so one component; null keys are passed over when the smallest key is sought, so a component has a null
component_id only if all its keys are null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import checkpointed, dropped, marked, partitions, read, stored, text_or_empty
from quern.llm.components import components

SEED = 42
#: Codes of a node (narrow and wide searches), of a tree's leaf, children of a tree's node.
NODE, WIDE_NODE, LEAF, FAN = 4096, 1024, 32, 8
#: Wide searches: codes that share their leading bits (on average), and the chance that two codes at 3/5 of the distance meet.
GROUP, RECALL = 1024, 0.999
#: Near copies by similarity: words of a shingle (the similarity is in `enough` and `prefixes`), bits between fingerprints of
#: candidates, bits between these and second fingerprints together. Of 128 bits, 19 +- 4 differ at a similarity of 4/5.
WORDS, WIDE, WIDE_LIMIT = 5, 17, 30
#: Counts of shingles by their leading bits, and the ranges in which tasks send them. They order shingles; results don't depend on them.
CELL_BITS, CELL_RANGES = 20, 16
#: Words of 64 bits that tell apart sets without moving them (`possible`).
PARITY = 8


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included. bytes.lower() and bytes.split() know A-Z and \\x20 \\x09-\\x0D only."""
    import xxhash

    ws = text.encode().lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    joined = map(b" ".join, zip(*(ws[i:] for i in range(words)))) if len(ws) >= words else [b" ".join(ws)]
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), joined), np.uint64, max(1, len(ws) - words + 1))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the numbers, as a signed 64-bit number."""
    if not len(h):
        return 0
    counts = sum(np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for i in range(0, len(h), 65536))
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.int64)[0])


def fingerprint(text: str, words: int = 3) -> int:
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], pa.int64())], ["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text")).mapInArrow(run, f"key {kind}, fp long").withColumnRenamed("key", key)


def bit_orders(distance: int, codes: int) -> tuple[list[list[int]], int]:
    """(orders of the 64 bits, number of leading bits): two codes within `distance` agree in the leading bits of one order."""
    if distance <= 3:
        blocks = [list(range(64 * i // (distance + 1), 64 * (i + 1) // (distance + 1))) for i in range(distance + 1)]
        return [sum(blocks[i:] + blocks[:i], []) for i in range(distance + 1)], min(map(len, blocks))
    lead, near = min(max(8, math.ceil(math.log2(max(codes, 1) / GROUP))), 24), distance * 3 // 5
    meet = math.comb(64 - near, lead) / math.comb(64, lead)
    rnd = np.random.default_rng(SEED)
    return [rnd.permutation(64).tolist() for _ in range(math.ceil(math.log(1 - RECALL) / math.log(1 - meet)))], lead


def permuted(codes: np.ndarray, order: list[int]) -> np.ndarray:
    """The codes with bit order[0] as the highest, order[1] as the next, and so on."""
    place, byte, out = np.empty(64, np.uint64), np.arange(256, dtype=np.uint64), np.zeros(len(codes), np.uint64)
    place[order] = np.arange(63, -1, -1, dtype=np.uint64)
    for k in range(8):
        table = np.zeros(256, np.uint64)
        for t in range(8):
            table |= (byte >> np.uint64(t) & np.uint64(1)) << place[8 * k + t]
        out |= table[(codes >> np.uint64(8 * k) & np.uint64(255)).astype(np.int64)]
    return out


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order: each bit xor all bits above it. Its inverse is rank ^ rank >> 1."""
    for shift in (1, 2, 4, 8, 16, 32):
        codes = codes ^ codes >> np.uint64(shift)
    return codes


def search(codes: np.ndarray, asked: np.ndarray, distance: int, same: bool, seen: Counter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index in asked, index in codes, differing bits) of all pairs within `distance`; codes are in Gray order, and if asked is
    the same array, each pair comes once. seen counts comparisons, and those spared by pruning above the leaves."""
    none = (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint8))
    found = [none]

    def visit(lo: int, hi: int, taken: np.uint64, who: np.ndarray, spent: np.ndarray) -> None:
        own = codes[lo:hi]
        shared = ~(np.bitwise_or.reduce(own) ^ np.bitwise_and.reduce(own)) & ~taken
        if same:
            who, spent = who[: np.searchsorted(who, hi)], spent[: np.searchsorted(who, hi)]
        spent = spent + np.bitwise_count((asked[who] ^ own[0]) & shared)
        near = spent <= distance
        who, spent, taken = who[near], spent[near], taken | shared
        if hi - lo > LEAF:
            seen["spared"] += int(len(near) - near.sum()) * (hi - lo)
        if not len(who):
            return
        if hi - lo <= LEAF:
            apart = spent[:, None] + np.bitwise_count((asked[who][:, None] ^ own) & ~taken)
            seen["compared"] += apart.size
            a, b = np.nonzero(apart <= distance)
            keep = who[a] < b + lo if same else slice(None)
            found.append((who[a][keep], (b + lo)[keep].astype(np.int32), apart[a, b][keep]))
        else:
            step = -(-(hi - lo) // FAN)
            for at in range(lo, hi, step):
                visit(at, min(at + step, hi), taken, who, spent)

    if len(codes) and len(asked):
        visit(0, len(codes), np.uint64(0), np.arange(len(asked), dtype=np.int32), np.zeros(len(asked), np.uint8))
    return tuple(np.concatenate(c) for c in zip(*found))


def forests(n: int, a: np.ndarray, b: np.ndarray, apart: np.ndarray, layers: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices, layers): a spanning forest of the links, then one of the links that are left, and so on."""
    left, out = np.arange(len(a)), [(np.zeros(0, np.int64),) * 2]
    for k in range(layers):
        own = left[forest(n, a[left], b[left], apart[left])]
        out.append((own, np.full(len(own), k)))
        left = np.setdiff1d(left, own, assume_unique=True)
    return tuple(np.concatenate(c) for c in zip(*out))


def forest(n: int, a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Of the links a-b among 0..n-1, the indices of a spanning forest that prefers near ones."""
    up, chosen = np.arange(n), []

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    order = np.argsort(apart, kind="stable")
    for at in range(0, len(order), 4096):
        while (up[up] != up).any():
            up = up[up]
        part = order[at : at + 4096]
        part = part[up[a[part]] != up[b[part]]]
        for i, x, y in zip(part.tolist(), a[part].tolist(), b[part].tolist()):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
                chosen.append(i)
    return np.array(chosen, np.int64)


PART = "k int, lead long, node long, low long, high long, one long, codes binary"


def earlier(orders: list[list[int]], lead: int) -> list[np.ndarray]:
    """For each order the leading bits of those before it, as masks over codes that are permuted by that order."""
    masks = np.array([sum(1 << bit for bit in order[:lead]) for order in orders], np.uint64)
    return [permuted(masks[:k], order) for k, order in enumerate(orders)]


def within(found: tuple[np.ndarray, ...], one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...], limit: int, before: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the pairs found (a in one, b in two, apart; both: codes, ids, second words and roots), those of two roots that differ in
    `limit` bits at most with the second words, and that don't meet in an order before: a pair belongs to the first that joins it."""
    a, b, apart = found
    apart = apart.astype(np.int32) + np.bitwise_count((one[2][a] ^ two[2][b]).view(np.uint64))
    keep = np.flatnonzero((apart <= limit) & (one[3][a] != two[3][b]))
    for mask in before:
        keep = keep[(one[0][a[keep]] ^ two[0][b[keep]]) & mask != 0]
    return a[keep], b[keep], apart[keep]


def node_rows(batches: Iterator[pa.RecordBatch], distance: int, limit: int, lead: int, size: int, layers: int, before: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Of a range partition of (k, rank, id, more, root), sorted: the links (a, b, apart, layer) inside its nodes, and the parts of runs of equal
    leading bits that may go on outside of their node, with their root if they have but one."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["a", "b", "apart", "layer", "k", "lead", "node", "low", "high", "one", "codes"]
    number = TaskContext.get().partitionId() << 32

    def rows(k: int, codes: np.ndarray, ids: np.ndarray, more: np.ndarray, roots: np.ndarray, is_open: tuple[bool, bool]) -> pa.RecordBatch:
        nonlocal number
        own = (codes, ids, more, roots)
        a, b, apart = within(search(codes, codes, distance, True, Counter()), own, own, limit, before[k])
        links, layer = forests(len(codes), a, b, apart, layers)
        heads = gray_rank(codes) >> np.uint64(64 - lead)
        runs = {tuple(int(np.searchsorted(heads, h, side)) for side in ("left", "right")) for h, is_cut in zip(heads[[0, -1]], is_open) if is_cut}
        columns = [[None] * len(links) for _ in range(7)]
        for lo, hi in sorted(runs):
            number += 1
            low, high = (int(f.reduce(codes[lo:hi]).view(np.int64)) for f in (np.bitwise_and, np.bitwise_or))
            one = int(roots[lo]) if (roots[lo:hi] == roots[lo]).all() else None
            packed = b"".join(c[lo:hi].tobytes() for c in own)
            for column, x in zip(columns, (k, int(heads[lo]), number, low, high, one, packed)):
                column.append(x)
        none = [None] * len(runs)
        both = [ids[a[links]].tolist() + none, ids[b[links]].tolist() + none, apart[links].tolist() + none, layer.tolist() + none, *columns]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(both, kinds)], names)

    held, left = None, True  # rows not yet in a node (k, code, id, more, root); whether what is left of them may belong to their first run
    for batch in _with_end(batches):
        if batch is not None:
            k, rank, own, more, root = (c.to_numpy() for c in batch.columns)
            rank = rank.view(np.uint64) ^ np.uint64(1 << 63)
            new = (k, rank ^ rank >> np.uint64(1), own, more, root)
            held = new if held is None else tuple(np.concatenate(c) for c in zip(held, new))
        while held is not None and len(held[0]) and (batch is None or len(held[0]) > size or held[0][0] != held[0][-1]):
            k, codes = held[:2]
            end = min(int(np.searchsorted(k, k[0], "right")), size)
            is_cut = end < len(k) and k[end] == k[0]
            if is_cut:  # rather between two runs than inside one
                heads = gray_rank(codes[: end + 1]) >> np.uint64(64 - lead)
                turns = np.flatnonzero(heads[1:] != heads[:-1]) + 1
                if len(turns):
                    end, is_cut = int(turns[-1]), False
            last = batch is None and end == len(k)
            yield rows(int(k[0]), *(c[:end] for c in held[1:]), (left, is_cut or last))
            left = is_cut
            held = tuple(c[end:] for c in held)


def pair_rows(batches: Iterator[pa.RecordBatch], distance: int, limit: int, layers: int, before: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The links between the codes of two parts, for each row of two parts."""
    for batch in batches:
        for k, x, y in zip(*(c.to_pylist() for c in batch.columns)):
            one, two = (np.frombuffer(z, np.uint64).reshape(4, -1) for z in (x, y))
            a, b, apart = within(search(two[0], one[0], distance, False, Counter()), one, two, limit, before[k])
            links, layer = forests(one.shape[1] + two.shape[1], a, b + one.shape[1], apart, layers)
            columns = [one[1].view(np.int64)[a[links]], two[1].view(np.int64)[b[links]], apart[links].astype(np.int32), layer.astype(np.int32)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["a", "b", "apart", "layer"])


def links(codes: DataFrame, distance: int, limit: int | None = None, layers: int = 1, node: int | None = None, chain: bool = False) -> DataFrame:
    """(a, b, apart, layer): forests of links between codes(fp, id, more[, root]), distinct rows that are stored; see above for what they
    join. Links differ in `distance` bits of fp at most, and if there is a limit, in so many of fp and more together. Codes of one
    root need no link: theirs are left out. With `chain`, a part of a run is searched with the next one only, not with all others.
    """
    limit = distance if limit is None else limit
    orders, lead = bit_orders(distance, codes.count() if distance > 3 else 0)
    before = earlier(orders, lead)
    size = node or (NODE if distance <= 3 else WIDE_NODE)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for k, order in enumerate(orders):
                rank = gray_rank(permuted(fp, order)) ^ np.uint64(1 << 63)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), k, np.int32)), pa.array(rank.view(np.int64)), *batch.columns[1:]], ["k", "rank", "id", "more", "root"])

    own = codes.select("fp", "id", "more", F.col("root" if "root" in codes.columns else "id").alias("root"))
    ranked = own.mapInArrow(spread, "k int, rank long, id long, more long, root long")
    ranked = ranked.repartitionByRange(partitions(codes.sparkSession), "k", "rank", "id").sortWithinPartitions("k", "rank", "id")
    found = stored(ranked.mapInArrow(partial(node_rows, distance=distance, limit=limit, lead=lead, size=size, layers=layers, before=before), f"a long, b long, apart int, layer int, {PART}"))
    parts = found.where("codes is not null")
    if chain:
        following = F.lead("node").over(Window.partitionBy("k", "lead").orderBy("node"))
        met = parts.select("k", F.col("node").alias("node_x"), following.alias("node_y")).where("node_y is not null")
        for s in "xy":
            met = met.join(parts.select(F.col("node").alias(f"node_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in ("low", "high", "one", "codes"))), f"node_{s}")
    else:
        x, y = (parts.select("k", "lead", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "low", "high", "one", "codes"))) for s in "xy")
        met = x.join(y, ["k", "lead"]).where("node_x < node_y")
    both = (F.col("low_x").bitwiseXOR(F.col("low_y"))).bitwiseAND(F.bitwise_not(F.col("low_x").bitwiseXOR(F.col("high_x")))).bitwiseAND(F.bitwise_not(F.col("low_y").bitwiseXOR(F.col("high_y"))))
    pairs = met.where((F.bit_count(both) <= distance) & F.coalesce(F.col("one_x") != F.col("one_y"), F.lit(True))).select("k", "codes_x", "codes_y")
    across = pairs.mapInArrow(partial(pair_rows, distance=distance, limit=limit, layers=layers, before=before), "a long, b long, apart int, layer int")
    return found.where("codes is null").select("a", "b", "apart", "layer").union(across)


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, distance: int = 2, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp and component_id, the smallest key that chains of links reach, for each row of docs."""
    fps = checkpointed(fingerprints(docs, words, key, text))
    nodes = checkpointed(fps.groupBy("fp").agg(F.min(key).alias("least")))
    roots = components(links(nodes.select("fp", F.col("fp").alias("id"), F.lit(0).cast("long").alias("more")), distance).select("a", "b"))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(named.select("fp", "root").join(lowest, "root").select("fp", "component_id"), "fp").select(key, "fp", "component_id")


# Near copies by similarity: the index proposes, whole shingle sets decide.


def sketches(texts: DataFrame, words: int) -> DataFrame:
    """(row, node, fp, more, n, parity) of texts(row, text): node is a hash of the set of shingles, fp the fingerprint, more a second
    one, n the size of the set, parity whether an odd number of its shingles falls on each bit; and from each task (part, counts): in how many of its texts, at most 255, shingles of each cell are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            h = [shingle_hashes(t, words) for t in batch.column(1).to_pylist()]
            sets = [np.unique(x) for x in h]
            for x in sets:
                np.add.at(total, cells(x), 1)
            words_ = [pa.array([majority(f(x)) for x in h], pa.int64()) for f in (lambda x: x, mixed)]
            sizes, odd = pa.array(map(len, sets), pa.int32()), pa.array(map(parity, sets), pa.list_(pa.int64()))
            none = [pa.nulls(len(h), kind) for kind in (pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(set_name, sets), pa.int64()), *words_, sizes, odd, *none], names)
        if total.any():
            counts = np.split(np.minimum(total, 255).astype(np.uint8), CELL_RANGES)
            none = [pa.nulls(CELL_RANGES, kind) for kind in (pa.binary(), *[pa.int64()] * 3, pa.int32(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(CELL_RANGES), pa.int32()), pa.array([c.tobytes() for c in counts], pa.binary())], names)

    names = ["row", "node", "fp", "more", "n", "parity", "part", "counts"]
    return texts.select("row", "text").mapInArrow(run, "row binary, node long, fp long, more long, n int, parity array<long>, part int, counts binary")


def set_name(shingles: np.ndarray) -> int:
    """A hash of a sorted set of shingles."""
    import xxhash

    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) - (1 << 63)


def parity(shingles: np.ndarray) -> np.ndarray:
    """PARITY words: for each of their bits, whether an odd number of the shingles falls on it."""
    bits = 64 * PARITY
    odd = np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def cells(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def frequency(found: DataFrame) -> np.ndarray:
    """A byte a cell: twice the logarithm of the sum of the tasks' (part, counts). One range of cells is summed by one task."""

    def summed(table: pa.Table) -> pa.Table:
        total = np.zeros((1 << CELL_BITS) // CELL_RANGES, np.int64)
        for counts in table.column("counts"):
            total += np.frombuffer(counts.as_py(), np.uint8)
        return pa.table({"part": table.column("part")[:1], "levels": pa.array([(2 * np.log2(total + 1)).astype(np.uint8).tobytes()], pa.binary())})

    parts = found.where("counts is not null").select("part", "counts").groupBy("part").applyInArrow(summed, "part int, levels binary").collect()
    return np.frombuffer(b"".join(r.levels for r in sorted(parts)) or bytes(1 << CELL_BITS), np.uint8)


def prefixes(texts: DataFrame, words: int, levels: np.ndarray) -> DataFrame:
    """(shingle, node, n, at) of texts(text): the rarest shingles of each text's set of n, one more than a fifth of it, by their place.

    All texts order shingles alike, by level and hash. Two sets with a Jaccard similarity of 4/5 have 4/5 of the larger one in common;
    of so many, the first in this order is among the first n - ceil(4n/5) + 1 of both, so they share one of these.
    """
    sent = texts.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, found = set(), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))]
            for text in batch.column(0).to_pylist():
                own = np.unique(shingle_hashes(text, words))
                if len(own) and (node := set_name(own)) not in seen:
                    seen.add(node)
                    first = own[np.argsort(sent.value[cells(own)], kind="stable")[: len(own) // 5 + 1]].view(np.int64)
                    found.append((first, np.full(len(first), node), np.full(len(first), len(own), np.int32), np.arange(len(first), dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["shingle", "node", "n", "at"])

    return texts.select("text").mapInArrow(run, "shingle long, node long, n int, at int")


def shared(rows: DataFrame, value: str) -> DataFrame:
    """Those of rows whose shingle stands beside two values or more."""
    w = Window.partitionBy("shingle")
    return rows.withColumn("_low", F.min(value).over(w)).withColumn("_high", F.max(value).over(w)).where("_low < _high").drop("_low", "_high")


def meeting(rows: DataFrame) -> DataFrame:
    """(a, b): nodes of rows(shingle, node, n, at, root) of two roots that share a shingle and may be similar by sizes and places.

    Behind the first shingle that two sets share, they have no more in common than the shorter rest: that is tested at every one.
    """
    a, b = (rows.select("shingle", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "at", "root"))) for s in "ab")
    both = a.join(b, "shingle").where("node_a < node_b and root_a <> root_b")
    rest = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    return both.where(enough(rest, F.col("n_a"), F.col("n_b"))).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def mixed(h: np.ndarray) -> np.ndarray:
    """Other hashes of the same things."""
    h = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of texts(node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def enough(common: Column, n: Column, m: Column) -> Column:
    """Whether sets of n and m with so many in common have a Jaccard similarity of 4/5."""
    return 9 * common >= 4 * (n + m)


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of pairs(a, b) that may be similar enough by the parities of nodes(node, n, parity); none that is gets lost.

    Where two parities differ, a shingle is in one set only, and each of those changes one bit. Sets of n and m at a similarity of
    4/5 have (n + m) / 9 such shingles at most.
    """
    a, b = (nodes.select(F.col("node").alias(s), F.col("n").alias(f"_n_{s}"), F.col("parity").alias(f"_p_{s}")) for s in "ab")
    differ = sum((F.bit_count(F.get("_p_a", F.lit(k)).bitwiseXOR(F.get("_p_b", F.lit(k)))) for k in range(PARITY)), F.lit(0))
    return pairs.join(a, "a").join(b, "b").where(9 * differ <= F.col("_n_a") + F.col("_n_b")).select("a", "b")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs(a, b) whose sets(node, shingles) are similar enough."""
    a, b = (sets.select(F.col("node").alias(k), F.col("shingles").alias(f"_{k}")) for k in "ab")
    both = pairs.join(a, "a").join(b, "b")
    return stored(both.where(enough(F.size(F.array_intersect("_a", "_b")), F.size("_a"), F.size("_b"))).select("a", "b"))


def near_texts(texts: DataFrame, words: int = WORDS, distance: int = WIDE, limit: int = WIDE_LIMIT) -> DataFrame:
    """(row, root) for texts(row, text): rows, a binary name of each, have one root if chains of links join their texts.

    A link is a Jaccard similarity of 4/5 or more between sets of shingles; equal sets are one node. The index proposes first: one
    forest of near fingerprints from each node and order, runs that are cut being followed from part to part. That joins large groups
    by few links, and may miss some. Then all nodes of different roots that share one of their rarest shingles are candidates: no
    link is left out.
    """
    found = stored(sketches(texts, words))
    rows = found.where("row is not null")
    nodes = stored(rows.groupBy("node").agg(F.min("row").alias("row"), *(F.first(c).alias(c) for c in ("fp", "more", "n", "parity"))))
    first = _candidates(links(nodes.select("fp", F.col("node").alias("id"), "more"), distance, limit, chain=True))
    linked = _similar(first, texts, nodes, words)
    roots = stored(components(linked))
    rare = stored(shared(prefixes(texts, words, frequency(found)), "node"))
    rooted = rare.distinct().join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = stored(shared(rooted, "root"))
    dropped(rare)
    second = _candidates(meeting(apart), tried=first)
    dropped(apart)
    roots = stored(components(linked.union(_similar(second, texts, nodes, words))))
    named = nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    return rows.select("row", "node").join(named, "node").select("row", "root")


def _similar(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """Those of pairs(a, b) that are similar enough, by sets that are made from the texts and deleted again."""
    left = stored(possible(pairs, nodes))
    sets = _sets(texts, nodes, left, words)
    found = similar(left, sets)
    dropped(sets)
    return found


def _sets(texts: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """The sets of the nodes that pairs(a, b) name, once each. Of the texts, only those of such nodes and few others are sent."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    asked = stored(nodes.join(ends, "node", "left_semi").select("node", "row"))
    sent = marked(texts, asked, "row").where("_marked").groupBy("row").agg(F.first("text").alias("text"))
    return stored(shingle_sets(sent.join(asked, "row").select("node", "text"), words))


def _candidates(found: DataFrame, tried: DataFrame | None = None) -> DataFrame:
    pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return stored(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash_near_dedup": op10_simhash_near_dedup}
ORACLE_SQL: dict[str, str] = {}
