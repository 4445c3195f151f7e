import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import suffix_dedup
from quern.llm.suffix_dedup import Run, merged, repeated_bytes, shared_lengths


def plain(docs, length=100):
    """{doc_id: (n_bytes, spans, kept)} from every window of every text."""
    first, out = {}, {}
    ordered = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    for doc, text in ordered:
        raw, gone = (text or "").encode(), set()
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in first:
                gone.update(range(i, i + length))
            else:
                first[w] = doc, i
        spans = []
        for i in sorted(gone):
            if spans and spans[-1][1] == i:
                spans[-1][1] = i + 1
            else:
                spans.append([i, i + 1])
        out[doc] = len(raw), [tuple(s) for s in spans], bytes(b for i, b in enumerate(raw) if i not in gone)
    return out


def fixture(seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(2, 9))) for _ in range(400)]

    def prose(n):
        return " ".join(rnd.choice(words) for _ in range(n))

    passages = [prose(rnd.randint(15, 60)) for _ in range(6)]
    texts = [None, "", "short", "x" * 99, "x" * 100, "x" * 101, "x" * 350, "ab" * 200, "\x00" * 250, prose(3000)]
    for _ in range(60):
        text = prose(rnd.randint(5, 120))
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randint(0, len(text))
            p = rnd.choice(passages)
            a = rnd.randint(0, len(p) // 2)
            text = text[:at] + p[a : rnd.randint(len(p) // 2, len(p))] + text[at:]
        texts.append(text)
    for t in list(texts[10:]):
        if rnd.random() < 0.4:
            cut = list(t)
            for _ in range(rnd.randint(0, 3)):
                cut[rnd.randrange(len(cut))] = rnd.choice("xyz")
            texts.append("".join(cut))
    rnd.shuffle(texts)
    return [(i * 7 - 100, t) for i, t in enumerate(texts)]


def result(df):
    return {r.doc_id: (r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in df.collect()}


@pytest.mark.parametrize("hot", [2000, 3])
def test_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    docs = fixture(hot) + [(None, "null key " + "y" * 120)]
    df = spark.createDataFrame([(*d, "n", 1, b"x") for d in docs], "doc_id long, text string, bucket string, key int, blob binary").repartition(5)
    if hot == 3:  # the share of all places that makes a gram hot is out of reach in a small table
        monkeypatch.setattr(suffix_dedup, "BUCKETS", 300)
    assert result(repeated_bytes(df)) == plain(docs)


def test_repeated_rows_equal_keys_and_no_rows(spark):
    rnd = random.Random(1)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(400))
    df = spark.createDataFrame([(1, text), (1, text), (2, "a" + text), (2, "another text " * 3), (3, text[:150])], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans]) for r in repeated_bytes(df).collect())
    assert got == [(1, 400, []), (1, 400, []), (2, 39, []), (2, 401, [(1, 401)]), (3, 150, [(0, 150)])]
    assert repeated_bytes(df.limit(0)).collect() == []


def test_loser_tree_gives_order_and_shared_prefixes():
    rnd = random.Random(2)
    for n in (1, 2, 3, 7):
        runs = []
        for _ in range(n):
            run = Run.__new__(Run)
            run.suffixes = sorted(bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 8))) for _ in range(rnd.randint(0, 30)))
            run.shared = shared_lengths(run.suffixes).tolist()
            runs.append(run)
        out = list(merged(runs))
        texts = [runs[r].suffixes[i] for r, i, _ in out]
        assert texts == sorted(t for r in runs for t in r.suffixes)
        assert [s for *_, s in out][1:] == shared_lengths(texts).tolist()[1:]


def test_query_equals_brute_force(spark, tmp_path):
    docs = fixture(9)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op1_suffix_dedup(spark, str(tmp_path)).collect()}
    assert got == {k: (n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest()) for k, (n, spans, kept) in plain(docs).items()}


def test_shared_lengths_of_many():
    texts = sorted(f"{i:06d}".encode() for i in range(140_000))
    plain = [0] + [next(k for k in range(7) if x[:k + 1] != y[: k + 1]) for x, y in zip(texts, texts[1:])]
    assert shared_lengths(texts).tolist() == plain


def test_texts_beyond_a_chunk_and_tasks_beyond_what_they_hold(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)
    long = letters[rnd.integers(0, 36, 5_000_000)].tobytes()  # more than CHUNK; no two strings of it are equal by chance
    passage, other = long[4_190_000:4_200_000], long[10:5010]
    texts = [long, b"!" + passage + b"?", long[:99] + b"#" + other, other[:99]]
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in suffix_dedup.repeated_bytes(df).collect()}
    assert got == {0: [], 1: [(1, 10_001)], 2: [(100, 5100)], 3: []}

    batch = pa.RecordBatch.from_arrays([pa.array(range(3), pa.int64()), pa.array([0, 0, 0], pa.int64()), pa.array([long[:9000], long[:4000], long[5000:9000]], pa.binary())], ["key", "tag", "text"])

    def places():
        found = set()
        for out in suffix_dedup.gram_rows(iter([batch]), 3, 4, 100):
            for bucket, blob in zip(out["bucket"].to_pylist(), out["blob"].to_pylist()):
                columns = suffix_dedup.unpacked(blob, *(("<u8", "<u4") if bucket >= 0 else ()), *suffix_dedup.PLACE)[-5:]
                found |= set(zip(*(c.tolist() for c in columns)))
        return found

    whole = places()
    monkeypatch.setattr(suffix_dedup, "HELD", 40)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 2000)
    assert places() == whole and len(whole) > 400
