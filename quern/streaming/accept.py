"""The acceptance rule as a stateful streaming query; it gives the rows of `operators.accept.accepted`."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from zlib import crc32

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues

from quern.operators.accept import static_rule
from quern.streaming.state import own, with_state

RESULT = "job long, seq long, score long, hash string, best_before long"


#: Hashes in one entry of a job's state, on average at most.
ENTRY = 256


class Acceptance(StatefulProcessor):
    """Of a job: the best score, and the hashes seen, in a number of entries that grows with them, of which a batch reads and writes only
    those of its own rows. With best_only just the hashes of the best score are kept: rows of a higher one are dropped and those of a
    lower one are new, as equal hashes have equal scores."""

    def __init__(self, base: int, best_only: bool):
        self.base, self.best_only = base, best_only

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "score long, hashes long, entries int")
        self.seen = handle.getMapState("seen", "entry int", "hashes array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        before = self.best.get()  # None: nothing was seen yet
        best, n, entries = before or (self.base, 0, 1)
        held: dict[int, set[str]] = {}
        batch, job = {}, own(key)

        def is_known(h: str) -> bool:
            if h in batch or not n:
                return h in batch
            at = crc32(h.encode()) % entries
            if at not in held:
                held[at] = self._entry(at)
            return h in held[at]

        for seq, score, h in sorted(((r.seq, r.score, r.hash) for r in rows), key=lambda r: (r[0] is not None, r)):
            if not (self.best_only and score > best):
                if score == 0 or (self.best_only and score < best) or not is_known(h):
                    if score != 0:
                        batch[h] = score
                    yield Row(job=job, seq=seq, score=score, hash=h, best_before=best)
            best = min(best, score)
        if self.best_only:
            batch = {h: score for h, score in batch.items() if score == best}
            if before and best < before[0]:
                if n:
                    self.seen.clear()
                held, n, entries = {}, 0, 1
        self._add(list(batch), held, n, entries, before, best)

    def _entry(self, at: int) -> set[str]:
        found = self.seen.getValue((at,))
        return set(found[0]) if found else set()

    def _add(self, new: list[str], held: dict[int, set[str]], n: int, entries: int, before: tuple | None, best: int) -> None:
        more = entries
        while n + len(new) > ENTRY * more:
            more *= 2
        if more > entries and n:  # an entry goes to those of equal remainder, one after the other
            for at in range(entries):
                parts: dict[int, list[str]] = {}
                for h in self._entry(at):
                    parts.setdefault(crc32(h.encode()) % more, []).append(h)
                for to in {at, *parts}:
                    self.seen.updateValue((to,), (parts.get(to, []),))
            held = {}
        parts = {}
        for h in new:
            parts.setdefault(crc32(h.encode()) % more, []).append(h)
        for at, hashes in parts.items():
            old = held[at] if at in held else self._entry(at) if n else set()
            self.seen.updateValue((at,), ([*old, *hashes],))
        after = (int(best), n + len(new), more)
        if before is None or after != tuple(before):
            self.best.update(after)


def accepted_stream(results: DataFrame, base: int, better_only: bool = False, best_only: bool = False, threshold: int | None = None, base_hash: str | None = None) -> DataFrame:
    """Rows must come with non-decreasing seq in each job; inside a batch they may come in any order. What a row alone decides is
    filtered before the shuffle. Null jobs are a job; rows with a null score or hash are not accepted."""
    rows = results.where(static_rule(results, base, better_only, threshold, base_hash)).select("job", "seq", "score", "hash")
    return with_state(rows, "job").transformWithState(Acceptance(base, best_only), RESULT, "append", "None")


def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over all that is there now, into Parquet below folder, and reads the result."""
    at = f"{folder}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")


def run_updates(stream: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Runs a streaming aggregation over all that is there now; each batch adds the groups that it changed, and the last of each key counts."""
    at = f"{folder}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("append").parquet(f"{at}/out")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{at}/state").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    values = [c for c in stream.columns if c not in keys]
    written = stream.sparkSession.read.schema(f"{', '.join(f'`{x.name}` {x.dataType.simpleString()}' for x in stream.schema)}, _batch long").parquet(f"{at}/out")
    return written.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_last")).select(*keys, *(F.col(f"_last.{c}") for c in values))
