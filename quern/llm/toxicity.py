"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

1. Lexicon: terms (words in plain form and word beginnings) that labelled toxic documents hold far more often than clean
   ones. Document frequencies are counted by Spark, in the labelled sample; only those terms reach the driver.
2. Features of a text: lexicon densities, how near hits stand to second-person words, capitals, punctuation, and how much
   is obfuscated (symbols, digits or stretched letters inside words, hits that only the plain form shows).
3. Trees: boosted on the features of at most SAMPLE labelled rows (those with the smallest hashes of their ids), with the
   rows' own half left out of the lexicon that their features come from. The model is a few hundred numbers.
4. Calibration: trees of one half score the other; pool-adjacent-violators on these scores gives the probabilities.
Scoring then is one pass over the documents, without a shuffle.

Defined cases: a null or empty text has zero features and gets a score like any other; repeated rows get equal scores; an
empty table gives an empty result; without labels of both kinds every score is the share of toxic labels, or 0; a doc_id
with contrary labels counts as toxic; of texts that share a labelled doc_id the smallest is learnt from; other columns are not
read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import CACHE_ENTRIES, CACHE_LENGTH, read, stored, text_or_empty

#: Bounds: labelled rows that the model is fitted on, and labelled toxic documents that a term must stand in.
SAMPLE, LEAST = 20_000, 4
PREFIXES = (5, 7)
NEAR = 5
THRESHOLD = 0.7
#: Second-person words of the corpus languages, and letters that symbols and digits stand for.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros os vuestro".split())
LOOK_ALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
WORD = re.compile(r"[^\s]+")
EDGES = re.compile(r"^[^\w@$]+|[^\w]+$")
INNER = re.compile(r"[^\W\d_][\W\d_]+(?=[^\W\d_])")
STRETCHED = re.compile(r"(.)\1{2,}")
NAMES = ("log_words", "hit_density", "weight_density", "log_hits", "distinct_hits", "top_weight", "hidden_hits", "near_second_person", "second_person", "capitals", "all_caps_words", "exclamations", "questions", "punctuation", "obfuscated_words", "stretched_words", "symbols")


def plain(word: str) -> str:
    """The word in lower case without edge symbols; where symbols or digits stand between letters, with what they stand for."""
    bare = EDGES.sub("", word).lower()
    if bare and not bare.isalpha() and any(c.isalpha() for c in bare):
        bare = "".join(c for c in bare.translate(LOOK_ALIKES) if c.isalpha())
    return STRETCHED.sub(r"\1", bare)


def terms(text: str) -> set[str]:
    """The plain words of a text, and the beginnings of its longer ones (marked by a final *)."""
    words = {plain(w) for w in set(WORD.findall(text))} - {""}
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n}


class Words(dict):
    """What the features need of a word, kept for as many words as the cache may hold: weight, whether it is a hit, whether it is
    obfuscated, the term hit, whether it is second-person, stretched, all capitals, a hidden hit, and its number of capitals."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon, self.room = lexicon, CACHE_ENTRIES

    def __missing__(self, word: str) -> tuple:
        p = plain(word)
        at = [t for t in (p, *(p[:k] + "*" for k in PREFIXES if len(p) > k)) if t in self.lexicon]
        score = max((self.lexicon[t] for t in at), default=0.0)
        odd = not word.isalpha() and bool(INNER.search(EDGES.sub("", word)))
        capitals = 0 if word.islower() else sum(map(str.isupper, word))
        x = (score, bool(at), odd, at[0] if at else "", p in SECOND_PERSON, bool(STRETCHED.search(word)), len(word) > 1 and word.isupper(), bool(at) and p not in word.lower(), capitals)
        if self.room and len(word) <= CACHE_LENGTH:
            self.room -= 1
            self[word] = x
        return x


def features(text: str, known: Words) -> list[float]:
    words = WORD.findall(text)
    n, size = max(len(words), 1), max(len(text), 1)
    hits, weight, top, hidden, second, odd, stretched, caps, upper = 0, 0.0, 0.0, 0, 0, 0, 0, 0, 0
    found, places, persons = set(), [], []
    for i, x in enumerate(map(known.__getitem__, words)):
        odd += x[2]
        stretched += x[5]
        caps += x[6]
        upper += x[8]
        if x[1]:
            hits += 1
            weight += x[0]
            top = max(top, x[0])
            hidden += x[7]
            found.add(x[3])
            places.append(i)
        if x[4]:
            second += 1
            persons.append(i)
    near = 0
    if places and persons:
        a, b = np.array(places), np.array(persons)
        k = np.searchsorted(b, a)
        gap = np.minimum(np.abs(a - b[np.minimum(k, len(b) - 1)]), np.abs(a - b[np.maximum(k - 1, 0)]))
        near = int((gap <= NEAR).sum())
    marks = sum(text.count(c) for c in ".,;:!?")
    symbols = sum(text.count(c) for c in "#*$%&@|<>")
    return [math.log1p(len(words)), hits / n, weight / n, math.log1p(hits), len(found), top, hidden / n, near / n, second / n, upper / size, caps / n, text.count("!") / size, text.count("?") / size, marks / size, odd / n, stretched / n, symbols / size]


class Trees(NamedTuple):
    """Boosted trees of equal depth: split feature and threshold of each inner node (heap order), and leaf values."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(int(math.log2(len(v)))):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - len(f)]
        return out


def boosted(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, weight: float = 2.0) -> Trees:
    """Newton boosting of the logistic loss on histograms; splits with no gain send every row left."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], 1)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = math.log(p / (1 - p))
    margin = np.full(len(y), start)
    features_, thresholds, values = [], [], []
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-margin))
        g, h = y - q, q * (1 - q)
        at, f, t = np.zeros(len(y), np.int64), np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            own = at - first
            best = np.full(width, 1e-6)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                cell, shape = own * bins + binned[:, j], (width, bins)
                gs = np.bincount(cell, g, width * bins).reshape(shape)
                hs = np.bincount(cell, h, width * bins).reshape(shape)
                gl, hl = gs.cumsum(1), hs.cumsum(1)
                G, H = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + weight) + (G - gl) ** 2 / (H - hl + weight) - G**2 / (H + weight)
                gain = gain[:, : len(e)]
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                better = top > best
                best = np.where(better, top, best)
                f[first : first + width][better], t[first : first + width][better] = j, e[k[better]]
            at = 2 * at + 1 + (x[np.arange(len(y)), f[at]] > t[at])
        leaf = at - (2**depth - 1)
        v = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + weight)
        margin += v[leaf]
        features_.append(f)
        thresholds.append(t)
        values.append(v)
    return Trees(start, np.array(features_), np.array(thresholds), np.array(values))


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (margins, probabilities) between which scores are interpolated."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # labels, rows, margins
    for m, label in zip(margin[order].tolist(), y[order].tolist()):
        blocks.append([label, 1.0, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, total = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + total]
    b = np.array(blocks)
    return b[:, 2] / b[:, 1], b[:, 0] / b[:, 1]


class Model(NamedTuple):
    lexicon: dict[str, float]
    trees: Trees | None
    at: np.ndarray
    chance: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The calibrated chance, with a hundredth of the plain sigmoid so that rows of one calibration block keep their order."""
        if self.trees is None or not len(x):
            return np.full(len(x), self.chance[0])
        margin = self.trees.margin(x)
        return np.clip(0.99 * np.interp(margin, self.at, self.chance) + 0.01 / (1 + np.exp(-margin)), 0, 1)


def held_out(key: str = "doc_id") -> Column:
    return (F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1) & F.col(key).isNotNull()


def lexicons(sample: DataFrame) -> list[dict[str, float]]:
    """Weights of the terms of sample(text, toxic, half): from rows of half 1, of half 0, and of both."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                found = [sorted(terms(t)) for t in part.column(0).to_pylist()]
                of_row = np.repeat(np.arange(len(part)), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array([t for f in found for t in f], pa.string()), part.column(1).take(pa.array(of_row)), part.column(2).take(pa.array(of_row))], ["term", "toxic", "half"])

    counts = sample.mapInArrow(of, "term string, toxic int, half int").groupBy("term").agg(*(F.count_if((F.col("half") == h) & (F.col("toxic") == t)).alias(f"n{h}{t}") for h in (0, 1) for t in (0, 1)))
    counted = stored(counts.where(F.col("n01") + F.col("n11") >= LEAST))
    n = {(r["half"], r["toxic"]): r["count"] for r in sample.groupBy("half", "toxic").count().collect()}
    out = []
    for halves in ((1,), (0,), (0, 1)):
        toxic, clean = (sum((F.col(f"n{h}{t}") for h in halves), F.lit(0)) for t in (1, 0))
        all_toxic, all_clean = (sum(n.get((h, t), 0) for h in halves) for t in (1, 0))
        weight = F.log((toxic + 0.5) / (all_toxic + 1.0)) - F.log((clean + 0.5) / (all_clean + 1.0))
        rows = counted.where((toxic >= LEAST) & (weight > 1.5)).select("term", weight.alias("w")).collect()
        out.append({r["term"]: r["w"] for r in rows})
    return out


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """labels(key, toxic) must hold only the rows to learn from."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("_key"), "_key").limit(SAMPLE)  # at most SAMPLE ids and labels, hence small enough to broadcast
    half = F.pmod(F.xxhash64("_key", F.lit(7)), F.lit(2)).cast("int").alias("half")
    sample = stored(docs.select(F.col(key).alias("_key"), text_or_empty(text).alias("text")).join(F.broadcast(chosen), "_key").groupBy("_key", "toxic").agg(F.min("text").alias("text")).select("text", "toxic", half))
    words = lexicons(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, toxic, h = (c.to_pylist() for c in batch.columns)
            known = [Words(w) for w in words[:2]]
            x = [features(s, known[k]) for s, k in zip(t, h)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "toxic", "half"])

    rows = sample.mapInArrow(run, "x array<double>, toxic int, half int").toArrow()
    x = np.array(rows["x"].to_pylist()).reshape(-1, len(NAMES))
    y, h = (rows[c].to_numpy().astype(float) for c in ("toxic", "half"))
    order = np.lexsort((*x.T, y))
    x, y, h = x[order], y[order], h[order]
    if not 0 < y.sum() < len(y) or len(set(h[y == 1])) < 2 or len(set(h[y == 0])) < 2:
        return Model({}, None, np.zeros(1), np.array([y.mean() if len(y) else 0.0]))
    other = np.zeros(len(y))
    for k in (0, 1):
        other[h == k] = boosted(x[h != k], y[h != k]).margin(x[h == k])
    return Model(words[2], boosted(x, y), *isotonic(other, y))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(model.lexicon)
        for batch in batches:
            x = np.array([features(t, known) for t in batch.column(1).to_pylist()]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], ["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text")).mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLE_SQL: dict[str, str] = {}
