"""Removal of repeated byte strings with a distributed merge sort of suffixes.

A byte goes if it lies in a string of `length` bytes that also starts earlier: in a document with a smaller key, or further
up in the same one. Strings that start at every byte would be too many to sort, so each is reached through its anchor:

1. Anchors. The grams (GRAM bytes) inside a string are hashed and the smallest hash, leftmost among equals, is its anchor.
   Equal strings have their anchors at equal places, and neighbouring strings mostly share one, so one suffix in about 30 is
   sorted, together with the few bytes left of it that its strings need.
2. Filter. Hashes of anchor grams are exchanged, each task's repeats first merged, and only anchors whose gram occurs twice go
   on: all other strings can't repeat. A false hit costs time only.
3. Runs. Each task sorts its suffixes by (hash of the first GRAM bytes, bytes) - an order in which equal beginnings stand
   together and whose ranges need no sampling - keeps one of equal ones and marks the others, and sends every range's part
   front-coded: the length of the prefix shared with the suffix before, and the rest.
4. Merge. A range's runs go through a loser tree whose nodes remember how long a prefix their loser shares with what beat it.
   Two suffixes with different remembered lengths are ordered by these alone, others are compared from there on only. The
   merged order comes with the shared prefix of each pair of neighbours.
5. Strings. Within suffixes that share their gram, the strings that start d bytes before the anchor are equal if the shared
   prefixes to the right and (after a sort of the reversed left parts) to the left are long enough. All but the first by
   (key, start) are marked.
6. Marks are joined back to the documents, merged to spans, and cut out.

Documents are dealt to buckets by a hash of key and text; the two joins share one exchange of the texts. There are as many
ranges and buckets as the bytes of all texts ask for, and no fewer than the session's shuffle partitions.

Defined cases: a null text is empty; texts shorter than `length` stay; rows with equal key and text are one document, all of
which get the same result; rows with equal key and different texts are different documents, in the order of a hash of their
texts; an empty table gives an empty result; other columns are not read; a null key counts as smaller than all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import partitions, read, stored, text_or_empty

LENGTH, GRAM = 100, 32
#: Bytes of text for each range of suffixes at most, buckets of documents for each range, and bytes hashed at once.
PART, BUCKETS, CHUNK = 1 << 25, 4, 1 << 22
#: Anchors that a task holds before it sends them, and places from which a gram may count as hot.
HELD, HOT = 2_000_000, 2000


def sliding(of, x: np.ndarray, width: int) -> np.ndarray:
    """of (np.minimum or np.maximum) over every `width` neighbours, in log(width) passes."""
    n = 1
    while 2 * n <= width:
        x, n = of(x[:-n], x[n:]), 2 * n
    return of(x[: len(x) - (width - n)], x[width - n :]) if n < width else x


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A 32-bit hash of the `size` bytes (a power of two) from each place on, by doubling."""
    kind = np.uint32
    h = (data.astype(kind) + kind(1)) * kind(0x9E3779B1)
    h ^= h >> kind(15)
    n = 1
    while n < size:
        h = h[:-n] * kind(0x85EBCA77) ^ (h[n:] << kind(13) | h[n:] >> kind(19))
        h = (h ^ h >> kind(16)) * kind(0xC2B2AE3D)
        n *= 2
    return h


def long_hashes(data: np.ndarray, at: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the `size` bytes from each place in `at` on."""
    kind = np.uint64
    words = np.zeros((len(at), size // 8), kind)
    for k in range(size):
        words[:, k // 8] |= data[at + k].astype(kind) << kind(8 * (k % 8))
    h = np.zeros(len(at), kind)
    for k in range(size // 8):
        h = (h ^ words[:, k]) * kind(0x9E3779B97F4A7C15)
        h ^= h >> kind(29)
        h *= kind(0xBF58476D1CE4E5B9)
        h ^= h >> kind(32)
    return h


def anchors(data: np.ndarray, sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For documents with `sizes` bytes one after another in data: (document, anchor, first start, last start), places in data.

    Each string of `length` bytes inside a document starts in exactly one of the ranges first..last.
    """
    none = (np.zeros(0, np.int64),) * 4
    n = len(data) - length + 1
    if n < 1:
        return none
    width = length - GRAM + 1
    h = gram_hashes(data)
    least = sliding(np.minimum, h, width)
    padded = np.zeros(n + 2 * (width - 1), np.uint32)
    padded[width - 1 : width - 1 + n] = least
    chosen = sliding(np.maximum, padded, width)[: len(h)] == h
    place = np.flatnonzero(chosen)
    turn = np.ones(n, bool)
    turn[1:] = (least[1:] != least[:-1]) | (chosen[: n - 1] & (h[: n - 1] == least[:-1]))
    first = np.flatnonzero(turn)
    last = np.append(first[1:], n) - 1
    k = np.searchsorted(place, first)
    todo = np.flatnonzero(h[place[k]] != least[first])
    while len(todo):
        k[todo] += 1
        todo = todo[h[place[k[todo]]] != least[first[todo]]]
    anchor = place[k]
    ends = np.cumsum(sizes)
    # A range may hold starts of several documents, of which only that of the anchor has strings with it.
    doc = np.searchsorted(ends, anchor, side="right")
    first, last = np.maximum(first, ends[doc] - sizes[doc]), np.minimum(last, ends[doc] - length)
    ok = first <= last
    return doc[ok], anchor[ok], first[ok], last[ok]


def packed(*columns: np.ndarray) -> bytes:
    """Columns of equal length as planes of bytes, compressed: the upper bytes of small or sorted numbers cost next to nothing."""
    n = len(columns[0])
    planes = [np.ascontiguousarray(c.reshape(n, 1).view(np.uint8).T).tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(n.to_bytes(8, "little") + b"".join(planes))


def unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for kind in kinds:
        size = np.dtype(kind).itemsize * n
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, size, at).reshape(-1, n).T).view(kind).reshape(n) if n else np.zeros(0, kind))
        at += size
    return out


#: A place: key, hash of its text (0 where keys are unique), anchor, bytes from the first and the last start to the anchor.
PLACE = ("<i8", "<u8", "<u4", "u1", "u1")


def split(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns of each bucket."""
    order = np.argsort(bucket, kind="stable")
    ids, starts = np.unique(bucket[order], return_index=True)
    for b, lo, hi in zip(ids.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)]):
        yield b, [c[order[lo:hi]] for c in columns]


def frames(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, tags, bytes, sizes) of the rows key, tag, text, by about CHUNK bytes."""
    keys, tags, text = (batch.column(i) for i in range(3))
    if not len(text):
        return
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    cuts = np.append(np.searchsorted(offsets[1:], np.arange(offsets[0] + CHUNK, offsets[-1], CHUNK)), len(text))
    keys, tags, cuts = keys.to_numpy(), tags.to_numpy().view(np.uint64), np.unique(cuts[cuts > 0])
    for a, b in zip([0, *cuts.tolist()], cuts.tolist()):
        yield keys[a:b], tags[a:b], data[offsets[a] : offsets[b]], np.diff(offsets[a : b + 1])


def blobs(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "blob"])


def gram_rows(batches: Iterator[pa.RecordBatch], ranges: int, buckets: int, length: int) -> Iterator[pa.RecordBatch]:
    """A task's anchors: by bucket of their hash, each hash once with its number here and its first place; the other places,
    which are known to repeat, under -1 - bucket of their document."""
    held, size = [], 0

    def out() -> pa.RecordBatch:
        h, *place = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(h, kind="stable")
        h, place = h[order], [c[order] for c in place]
        new = np.append(True, h[1:] != h[:-1])
        first = np.flatnonzero(new)
        number = np.diff(np.append(first, len(h))).astype("<u4")
        rows = [(b, packed(*c)) for b, c in split((h[first] >> np.uint64(32)) % np.uint64(ranges), h[first], number, *(c[first] for c in place))]
        rest = [c[~new] for c in place]
        return blobs(rows + [(-1 - b, packed(*c)) for b, c in split(doc_bucket(*rest[:2], buckets), *rest)])

    for batch in batches:
        for keys, tags, data, sizes in frames(batch):
            doc, anchor, first, last = anchors(data, sizes, length)
            starts = np.cumsum(sizes) - sizes
            held.append((long_hashes(data, anchor), keys[doc], tags[doc], (anchor - starts[doc]).astype("<u4"), (anchor - first).astype("u1"), (anchor - last).astype("u1")))
            size += len(doc)
            if size > HELD:
                yield out()
                held, size = [], 0
    if size:
        yield out()


def repeated_rows(group: pa.Table, buckets: int) -> pa.Table:
    """Of one bucket of grams, the places whose gram occurs twice or more, by bucket of their document; besides, the grams
    with HOT places or more and the number of all places (hash null)."""
    own = group["blob"].to_pylist()
    if (bucket := group["bucket"][0].as_py()) < 0:
        n = sum(len(unpacked(b, *PLACE)[0]) for b in own)
        rows, hot = [(-1 - bucket, b) for b in own], [(None, n)]
    else:
        h, number, *place = (np.concatenate(c) for c in zip(*(unpacked(b, "<u8", "<u4", *PLACE) for b in own)))
        order = np.lexsort((place[2], place[1], place[0], h))
        h, number, place = h[order], number[order].astype(np.int64), [c[order] for c in place]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        total = np.add.reduceat(number, first)
        many = np.repeat(total, np.diff(np.append(first, len(h)))) > 1
        rows = [(b, packed(*c)) for b, c in split(doc_bucket(place[0][many], place[1][many], buckets), *(c[many] for c in place))]
        hot = [(None, len(h)), *zip(h[first][total >= HOT].view(np.int64).tolist(), total[total >= HOT].tolist())]
    table = pa.Table.from_batches([blobs(rows)])
    more = pa.table([pa.nulls(len(hot), pa.int32()), pa.nulls(len(hot), pa.binary()), pa.array([h for h, _ in hot], pa.int64()), pa.array([n for _, n in hot], pa.int64())], ["bucket", "blob", "hash", "n"])
    return pa.concat_tables([table.append_column("hash", pa.nulls(len(rows), pa.int64())).append_column("n", pa.nulls(len(rows), pa.int64())), more])


def doc_bucket(key: np.ndarray, tag: np.ndarray, buckets: int) -> np.ndarray:
    x = (key.view(np.uint64) ^ tag) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ x >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def shared_lengths(texts: list[bytes]) -> np.ndarray:
    """The length of the prefix that each of the texts shares with the one before."""
    if not texts:
        return np.zeros(0, np.int64)
    sizes = np.array([len(t) for t in texts])
    table = np.zeros((len(texts), max(1, sizes.max())), np.uint8)
    table[np.arange(table.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(texts), np.uint8)
    out = np.zeros(len(texts), np.int64)
    for lo in range(1, len(texts), 65536):
        part = table[lo - 1 : lo + 65536]
        differ = part[1:] != part[:-1]
        out[lo : lo + 65536] = np.where(differ.any(1), differ.argmax(1), table.shape[1])
    return np.minimum(out, np.minimum(sizes, np.append(0, sizes[:-1])))


HEAD = 8  # bytes of hash in front of each sorted suffix


def run_rows(left: pa.Table, right: pa.Table, hot: np.ndarray, ranges: int, length: int) -> pa.Table:
    """Of one bucket of documents (left: bucket, key, tag, text) and their repeated anchors (right): front-coded sorted runs by
    range, and under -1 - bucket the marks of suffixes that are not their run's first.

    A hot gram's suffixes would crowd one range, so each of its strings is an item of its own, headed by the string's hash.
    """
    if not len(left) or not len(right):
        return pa.Table.from_batches([blobs([])])
    key, tag, anchor, back, near = (np.concatenate(c) for c in zip(*(unpacked(b, *PLACE) for b in right["blob"].to_pylist())))
    order = np.lexsort((anchor, tag, key))
    key, tag, anchor, back, near = (c[order] for c in (key, tag, anchor, back, near))
    new = np.append(True, (key[1:] != key[:-1]) | (tag[1:] != tag[:-1]) | (anchor[1:] != anchor[:-1]))  # equal rows give equal places
    key, tag, anchor, back, near = (c[new] for c in (key, tag, anchor, back, near))
    text_of = dict(zip(zip(left["key"].to_pylist(), left["tag"].to_pylist()), left["text"]))
    bounds = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (tag[1:] != tag[:-1])))
    items = []  # suffix behind its head, bytes to its left reversed, its place, bytes from first and last start to the anchor
    for lo, hi in zip(bounds.tolist(), [*bounds[1:].tolist(), len(key)]):
        raw = text_of[int(key[lo]), int(tag[lo : lo + 1].view(np.int64)[0])].as_buffer().to_pybytes()
        h = long_hashes(np.frombuffer(raw, np.uint8), anchor[lo:hi].astype(np.int64))
        heads, is_hot = h.astype(">u8").tobytes(), np.isin(h, hot).tolist()
        for i, (p, a, b) in enumerate(zip(anchor[lo:hi].tolist(), back[lo:hi].tolist(), near[lo:hi].tolist())):
            if is_hot[i]:
                for d in range(b, a + 1):
                    head = xxhash.xxh64_digest(raw[p - d : p - d + length], seed=d)
                    items.append((head + raw[p : p - d + length], raw[p - d : p][::-1], lo + i, d, d))
            else:
                items.append((heads[8 * i : 8 * i + 8] + raw[p : p - b + length], raw[p - a : p][::-1], lo + i, a, b))
    items.sort()  # equal ones by place
    first = np.array([True] + [x[:2] != y[:2] for x, y in zip(items, items[1:])])
    at, back, near = (np.array([x[k] for x in items]) for k in (2, 3, 4))
    key, tag, anchor = key[at], tag[at], anchor[at].astype(np.int64)
    rows = []
    if not first.all():
        rows.append((-1 - left["bucket"][0].as_py(), packed(*marks(key[~first], tag[~first], (anchor - back)[~first], (anchor - near)[~first] + length))))
    items = [x for x, f in zip(items, first.tolist()) if f]
    key, tag, anchor, back, near = key[first], tag[first], anchor[first].astype("<u4"), back[first].astype("u1"), near[first].astype("u1")
    head = np.frombuffer(b"".join(x[0][:HEAD] for x in items), ">u8").astype(np.uint64)
    target = (head // np.uint64(((1 << 64) - 1) // ranges + 1)).astype(np.int64)
    cuts = np.flatnonzero(np.append(True, target[1:] != target[:-1])).tolist()
    for lo, hi in zip(cuts, [*cuts[1:], len(items)]):
        texts, k = [x[0] for x in items[lo:hi]], slice(lo, hi)
        shared = shared_lengths(texts)
        strings = b"".join(t[n:] for t, n in zip(texts, shared.tolist())) + b"".join(x[1] for x in items[k])
        numbers = packed(key[k], tag[k], anchor[k], back[k], near[k], shared.astype("u1"))
        rows.append((int(target[lo]), len(numbers).to_bytes(4, "little") + numbers + zstandard.ZstdCompressor(level=1).compress(strings)))
    return pa.Table.from_batches([blobs(rows)])


def marks(key: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    return key, tag, start.astype("<u4"), end.astype("<u4")


MARK = ("<i8", "<u8", "<u4", "<u4")


class Run:
    """A sorted run: suffixes with the prefixes that they share with the one before, left parts and places."""

    def __init__(self, blob: bytes, length: int):
        n = int.from_bytes(blob[:4], "little")
        *self.place, self.shared = unpacked(blob[4 : 4 + n], *PLACE, "u1")
        strings = zstandard.ZstdDecompressor().decompress(blob[4 + n :])
        back, near, at = self.place[3].tolist(), self.place[4].tolist(), 0
        self.suffixes, self.lefts, before = [], [], b""
        self.shared = self.shared.tolist()
        for b, s in zip(near, self.shared):
            to = at + HEAD + length - b - s
            before = before[:s] + strings[at:to]
            self.suffixes.append(before)
            at = to
        for a in back:
            self.lefts.append(strings[at : at + a])
            at += a


def merged(runs: list[Run]) -> Iterator[tuple[int, int, int]]:
    """(run, place in it, prefix shared with the one before) of all suffixes in order, by a loser tree.

    A contender's known prefix is what it shares with the last winner of its node. The one with the longer known prefix is
    the smaller; where both are equal, bytes are compared from there on, and the loser keeps the length that was found.
    """
    size = 1
    while size < len(runs):
        size *= 2
    suffixes = [r.suffixes for r in runs] + [[]] * (size - len(runs))
    shared = [r.shared for r in runs] + [[]] * (size - len(runs))
    at, ends = [0] * size, [len(s) for s in suffixes]
    known = [0] * size  # of the head of each run
    loser = [-1] * size

    def beats(a: int, b: int) -> bool:
        """Whether the head of a goes before that of b; the loser's known prefix becomes the one it shares with the winner."""
        if at[a] >= ends[a]:
            return False
        if at[b] >= ends[b]:
            return True
        k = known[a]
        if k != known[b]:
            return k > known[b]
        x, y = suffixes[a][at[a]], suffixes[b][at[b]]
        p, q = x[k:], y[k:]
        if p == q:
            known[max(a, b)] = len(x)
            return a < b
        n = min(len(p), len(q))
        diff = int.from_bytes(p[:n], "big") ^ int.from_bytes(q[:n], "big")
        k += n - (diff.bit_length() + 7) // 8
        won = p < q
        known[b if won else a] = k
        return won

    def play(node: int) -> int:
        if node >= size:
            return node - size
        a, b = play(2 * node), play(2 * node + 1)
        won, lost = (a, b) if beats(a, b) else (b, a)
        loser[node] = lost
        return won

    winner = play(1) if size > 1 else 0
    while at[winner] < ends[winner]:
        yield winner, at[winner], known[winner]
        i = at[winner] = at[winner] + 1
        known[winner] = shared[winner][i] if i < ends[winner] else 0
        node = (winner + size) // 2
        while node:
            other = loser[node]
            if beats(other, winner):
                loser[node], winner = winner, other
            node //= 2


def found_rows(group: pa.Table, length: int, buckets: int) -> pa.Table:
    """Of one range of runs, the marks by bucket of their document; marks that runs already gave pass through."""
    if (bucket := group["bucket"][0].as_py()) < 0:
        return pa.Table.from_batches([blobs([(-1 - bucket, b) for b in group["blob"].to_pylist()])])
    runs = [Run(b, length) for b in group["blob"].to_pylist()]
    base = np.cumsum([0] + [len(r.suffixes) for r in runs])
    order = list(merged(runs))
    at = np.array([base[r] + i for r, i, _ in order], np.int64)
    shared = np.array([s for *_, s in order], np.int64)
    suffixes = [runs[r].suffixes[i] for r, i, _ in order]
    lefts = [runs[r].lefts[i] for r, i, _ in order]
    key, tag, anchor, back, near = (np.concatenate(c)[at] for c in zip(*(r.place for r in runs)))
    anchor, back, near = (c.astype(np.int64) for c in (anchor, back, near))
    out = [marks(key[:0], tag[:0], anchor[:0], anchor[:0])]
    group_of = np.cumsum(shared < HEAD + GRAM)
    starts = np.flatnonzero(np.append(True, group_of[1:] != group_of[:-1])) if len(order) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(order)))
    at = np.flatnonzero(np.repeat(sizes > 1, sizes))
    if len(at):
        out += later(at, shared, suffixes, lefts, key, tag, anchor, back, near, length)
    key, tag, start, end = (np.concatenate(c) for c in zip(*out))
    return pa.Table.from_batches([blobs([(b, packed(*c)) for b, c in split(doc_bucket(key, tag, buckets), key, tag, start, end)])])


def later(at: np.ndarray, shared: np.ndarray, suffixes: list, lefts: list, key, tag, anchor, back, near, length: int) -> list[tuple[np.ndarray, ...]]:
    """Marks of the strings of suffixes `at` (whole groups of equal grams) that are not the first of their kind."""
    n = len(at)
    shared = shared[at].copy()
    shared[np.append(True, at[1:] != at[:-1] + 1)] = 0
    key, tag, anchor, back, near = (c[at] for c in (key, tag, anchor, back, near))
    own = [lefts[i] for i in at.tolist()]
    by_left = np.array(sorted(range(n), key=own.__getitem__), np.int64)
    left_shared = shared_lengths([own[i] for i in by_left.tolist()])
    rank = np.empty(n, np.int64)
    by_place = np.lexsort((anchor, tag, key))
    same = np.append(False, (key[by_place][1:] == key[by_place][:-1]) & (tag[by_place][1:] == tag[by_place][:-1]) & (anchor[by_place][1:] == anchor[by_place][:-1]))
    rank[by_place] = np.cumsum(~same)

    def classes(right: np.ndarray, left: int | np.ndarray) -> np.ndarray:
        of_left = np.empty(n, np.int64)
        of_left[by_left] = np.cumsum(left_shared < left)
        return np.cumsum(shared < right) * (n + 1) + of_left

    def not_first(kinds: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Which of the rows have a row of the same kind and a smaller rank."""
        order = np.lexsort((ranks, kinds))
        k, r = kinds[order], ranks[order]
        head = np.append(True, k[1:] != k[:-1])
        least = r[np.flatnonzero(head)][np.cumsum(head) - 1]
        out = np.empty(len(kinds), bool)
        out[order] = r > least
        return out

    # Suffixes that are equal with all that belongs to them, left parts included, first: all strings of the later ones repeat.
    size = np.array([len(suffixes[i]) for i in at.tolist()])
    left_size = np.array([len(x) for x in own])
    before = np.append(0, size[:-1])
    left_before = np.append(0, left_size[by_left][:-1])
    whole = np.cumsum(~((shared == size) & (before == size)))
    of_left = np.empty(n, np.int64)
    of_left[by_left] = np.cumsum(~((left_shared == left_size[by_left]) & (left_before == left_size[by_left])))
    copy = not_first(whole * (n + 1) + of_left, rank)
    out = [marks(key[copy], tag[copy], (anchor - back)[copy], (anchor - near)[copy] + length)]
    gram = np.cumsum(shared < HEAD + GRAM)
    alive = np.flatnonzero(~copy)
    alive = alive[np.bincount(gram[alive])[gram[alive]] > 1]
    for d in range(length - GRAM + 1):
        part = alive[(near[alive] <= d) & (d <= back[alive])]
        if len(part) > 1:
            hit = part[not_first(classes(HEAD + length - d, d)[part], rank[part])]
            out.append(marks(key[hit], tag[hit], anchor[hit] - d, anchor[hit] - d + length))
    return out


def cut_rows(left: pa.Table, right: pa.Table) -> pa.Table:
    """Of one bucket of documents and their marks: key, tag, n_bytes, spans and the bytes that are left."""
    found = {}
    if len(right):
        key, tag, start, end = (np.concatenate(c) for c in zip(*(unpacked(b, *MARK) for b in right["blob"].to_pylist())))
        order = np.lexsort((start, tag, key))
        key, tag, start, end = key[order], tag[order].view(np.int64), start[order].astype(np.int64), end[order].astype(np.int64)
        bounds = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (tag[1:] != tag[:-1])))
        for lo, hi in zip(bounds.tolist(), [*bounds[1:].tolist(), len(key)]):
            s, e = start[lo:hi], np.maximum.accumulate(end[lo:hi])
            new = np.append(True, s[1:] > e[:-1])
            found[int(key[lo]), int(tag[lo])] = list(zip(s[new].tolist(), e[np.append(np.flatnonzero(new)[1:] - 1, hi - lo - 1)].tolist()))
    sizes, spans, kept = [], [], []
    for k, t, text in zip(left["key"].to_pylist(), left["tag"].to_pylist(), left["text"]):
        raw, own = text.as_buffer().to_pybytes() if text.as_buffer() else b"", found.get((k, t), [])
        sizes.append(len(raw))
        spans.append([{"start": a, "end": b} for a, b in own])
        kept.append(b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in own)], [*(s for s, _ in own), len(raw)])))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table([left["key"], left["null_key"], pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["key", "null_key", "n_bytes", "spans", "kept"])


def repeated_bytes(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, spans (removed, maximal) and kept (binary) for each row of docs. Keys are whole numbers."""
    least = F.lit(-(2**63)).cast("long")
    base = docs.select(F.coalesce(F.col(key).cast("long"), least).alias("key"), F.col(key).isNull().alias("null_key"), text_or_empty(text).alias("text"))
    unique = base.select("key").groupBy("key").count().where("count > 1").isEmpty()
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    session = partitions(docs.sparkSession)
    ranges = max(session, -(-size // PART))
    buckets = BUCKETS * ranges

    def dealt(df: DataFrame) -> DataFrame:
        """df by bucket, in more partitions than the session's where these would be too large."""
        return (df if ranges == session else df.repartition(ranges, "bucket")).groupBy("bucket")

    tag = F.lit(0).cast("long") if unique else F.xxhash64("text", "null_key")
    base = base.select("key", tag.alias("tag"), F.col("text").cast("binary").alias("text"), "null_key")
    names = "bucket int, blob binary"
    grams = base.select("key", "tag", "text").mapInArrow(lambda b: gram_rows(b, ranges, buckets, length), names)
    repeated = stored(dealt(grams).applyInArrow(lambda g: repeated_rows(g, buckets), f"{names}, hash long, n long"))
    counts = repeated.where("bucket is null")
    places = counts.where("hash is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    # At most 4 x buckets grams can hold so many places.
    hot = np.array([r["hash"] for r in counts.where(F.col("hash").isNotNull() & (F.col("n") >= max(HOT, places // (4 * buckets)))).select("hash").collect()], np.int64).view(np.uint64)
    repeated = repeated.where("bucket is not null").select("bucket", "blob")

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, t = (batch.column(i).to_numpy() for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(doc_bucket(k, t.view(np.uint64), buckets).astype(np.int32)), *batch.columns], ["bucket", *batch.schema.names])

    texts = base.mapInArrow(bucketed, "bucket int, key long, tag long, text binary, null_key boolean")
    runs = dealt(texts).cogroup(dealt(repeated)).applyInArrow(lambda a, b: run_rows(a, b, hot, ranges, length), names)
    found = dealt(runs).applyInArrow(lambda g: found_rows(g, length, buckets), names)
    cut = dealt(texts).cogroup(dealt(found)).applyInArrow(cut_rows, "key long, null_key boolean, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return cut.select(F.when(~F.col("null_key"), F.col("key")).alias(key), "n_bytes", "spans", "kept")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_bytes(read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
