"""Token counts by the whole-token shortcut.

Offline, `whole_tokens` proves which vocabulary strings encode alone as one token. In the tasks a text is cut into
pre-tokens, which no merge can cross; a pre-token that is in the proven set counts as one token at once, and only the
rest is merged, by the library itself. The set has at most one entry for each vocabulary string, so it is broadcast.

Defined cases: a null or empty text has 0 bytes and 0 tokens; repeated rows and rows with equal ids each give a row;
an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import CACHE_ENTRIES, CACHE_LENGTH, read, text_or_empty, tokenizer_path
from quern.llm.pieces import UNITS, marked, pieces


class Counts(dict):
    """Pre-token -> number of tokens, filled with the proven pre-tokens and, as they come, with merged ones."""

    def __init__(self, path: str, proven: frozenset[str]):
        super().__init__(dict.fromkeys(proven, 1))
        self.encode, self.room = pieces(path).model.encode, CACHE_ENTRIES

    def __missing__(self, unit: str) -> int:
        # The model puts a word mark in front: it stands for the unit's own first space, or is split off by a line feed.
        n = len(self.encode(unit[1:])) if unit[0] == " " and len(unit) > 1 else len(self.encode("\n" + unit)) - 2
        if self.room and len(unit) <= CACHE_LENGTH:
            self.room -= 1
            self[unit] = n
        return n


_counts: dict[str, Counts] = {}


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that the library encodes, alone, as exactly one token."""
    model = pieces(path)
    spaced = [t for t in model.id if t[0] == " " and len(t) > 1]
    bare = [t for t in model.id if t[0] != " "]
    found = {t for t, ids in zip(spaced, model.model.encode([t[1:] for t in spaced])) if ids == [model.id[t]]}
    return frozenset(found | {t for t, ids in zip(bare, model.model.encode(["\n" + t for t in bare])) if ids[2:] == [model.id[t]]})


def token_counts(docs: DataFrame, path: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens and over_limit for each row of docs."""
    proven = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counts:
            _counts[path] = Counts(path, proven.value)
        counts = _counts[path]
        for batch in batches:
            texts = batch.column(1)
            units = (UNITS.findall(marked(t)) for t in texts.to_pylist())
            n = [sum(itemgetter(*u)(counts)) if len(u) > 1 else sum(map(counts.__getitem__, u)) for u in units]
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(n, pa.int64())], ["key", "n_bytes", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    counted = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text")).mapInArrow(count, f"key {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {"op3_token_counts": op3_token_counts}
ORACLE_SQL: dict[str, str] = {}
