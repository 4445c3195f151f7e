import random
from collections import Counter

import pytest
from pyspark.sql import Row

from quern.streaming import accept


class Store:
    """The state of one job, which counts what is asked of it."""

    def __init__(self):
        self.value, self.entries, self.calls = None, {}, Counter()

    def getValueState(self, name, schema):
        return Value(self)

    def getMapState(self, name, key, value):
        return Entries(self)


class Value:
    def __init__(self, store):
        self.store = store

    def exists(self):
        return self.store.value is not None

    def get(self):
        self.store.calls["read"] += 1
        return self.store.value

    def update(self, value):
        self.store.calls["write"] += 1
        self.store.value = value


class Entries:
    def __init__(self, store):
        self.store = store

    def containsKey(self, key):
        self.store.calls["read"] += 1
        return key in self.store.entries

    def getValue(self, key):
        self.store.calls["read"] += 1
        return self.store.entries.get(key)

    def updateValue(self, key, value):
        self.store.calls["write"] += 1
        self.store.entries[key] = value

    def clear(self):
        self.store.calls["write"] += 1
        self.store.entries = {}


def accepted(batches, best_only, base=100):
    store, job = Store(), accept.Acceptance(base, best_only)
    job.init(store)
    return [(r.seq, r.best_before) for part in batches for r in job.handleInputRows((False, 1), iter(part), None)], store


def plain(rows, best_only, best=100):
    seen, out = set(), []
    for r in rows:
        if (r.score == 0 or r.hash not in seen) and not (best_only and r.score > best):
            out.append((r.seq, best))
        seen.add(r.hash)
        best = min(best, r.score)
    return out


@pytest.mark.parametrize("best_only", [False, True])
def test_entries_that_split_keep_the_rule(monkeypatch, best_only):
    monkeypatch.setattr(accept, "ENTRY", 3)
    for seed in range(60):
        rnd = random.Random(seed)
        rows = [Row(seq=i, score=s, hash=f"{s}-{rnd.randint(0, 3)}") for i in range(200) for s in [rnd.randint(0 if seed % 2 else 1, 90) + max(0, 60 - i)]]
        batches = [rows[i : i + size] for size in [rnd.choice([1, 7, 50])] for i in range(0, len(rows), size)]
        found, store = accepted([rnd.sample(b, len(b)) for b in batches], best_only)
        assert found == plain(rows, best_only)
        if not best_only:
            assert max(len(v[0]) for v in store.entries.values()) <= 20 and len(store.entries) > 20


def test_a_job_asks_its_state_few_times():
    rows = [Row(seq=i, score=99 - i // 2, hash=f"h{i}") for i in range(120)]
    for best_only, most in ((False, 4), (True, 4)):
        found, store = accepted([rows], best_only)
        assert len(found) == 120 and sum(store.calls.values()) <= most
    _, store = accepted([rows[:60], rows[60:]], True)
    assert len(store.entries[(0,)][0]) == 2 and sum(store.calls.values()) <= 8
