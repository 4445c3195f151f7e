import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import catalog, line_dedup, packing, piece_codec, quality, secret_scan, token_counts, toxicity, vector_search
from quern.llm.common import tokenizer_path
from tests.compare import assert_equal

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "a", "  two  spaces\n\n\n   and lines \t tabs", "▁mark ▁▁x", "日本語 text 🎉 émoji", "<|endoftext|> and <s> </s> <unk>", "x" * 5000, "#*$%&|<> !!! #", "\xa0odd spaces\x1c\x85", "don't we'll 'S 123abc ½ ²", "\x00 null byte"]


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert_equal(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], SF)


def texts():
    rnd = random.Random(11)
    words = ["the", "cat", "ü", "running", "x1", "foo_bar", "A.B", "12,5", "and\n", "  ", "Zürich!", "réeux"]
    return ODD + [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 400))) for _ in range(40)] + ["word " * 30_000]


def frame(spark, rows):
    """Documents with further columns, some with the operators' own names."""
    return spark.createDataFrame([(*r, "k", 1, 2.0, None) for r in rows], "doc_id long, text string, key string, n_tokens int, score double, _words string")


@pytest.fixture(scope="module")
def docs(spark):
    rows = list(enumerate(texts())) + [(3, texts()[3])]
    return frame(spark, rows).repartition(3), rows


def test_token_counts_and_codec_equal_the_library(docs):
    import sentencepiece

    df, rows = docs
    path = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    counts = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(df, path).collect()}
    coded = {r.doc_id: r for r in piece_codec.encode_decode(df, path, with_output=True).collect()}
    for i, t in rows:
        ids = sp.encode(t or "")
        assert counts[i] == (len((t or "").encode()), len(ids), len(ids) > 4096)
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        back = sp.decode(ids)
        assert (coded[i].ids, coded[i].decoded) == (ids, back)
        assert coded[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert coded[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    assert token_counts.token_counts(df.limit(0), path).collect() == [] == piece_codec.encode_decode(df.limit(0), path).collect()


def test_packing(docs, spark):
    from tokenizers import Tokenizer

    df, rows = docs
    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = packing.pack(df, path, with_ids=True).collect()
    bins, pieces = {}, {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, {}).setdefault(r.piece, []).append(r)
    for placed in bins.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= 1024
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        found = [pieces[i][k][0] for k in sorted(pieces[i])]
        assert [x for r in found for x in r.ids] == ids
        assert all(r.length == 1024 for r in found[1:]) and (len(ids) > 1024 or len(found) == 1)
        assert [r.start for r in found] == np.cumsum([0] + [r.length for r in found[:-1]]).tolist()
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in found)
    assert packing.pack(df.limit(0), path).collect() == []


def plain_lines(rows):
    first, out = {}, {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        ls = text.split("\n") if text is not None else []
        gone = set()
        for i in range(len(ls) - 2):
            w = tuple(ls[i : i + 3])
            if not re.search(r"[^ \t\n\x0b\f\r]", "".join(w)):
                continue
            if w in first:
                gone |= {i, i + 1, i + 2}
            else:
                first[w] = doc, i
        out[doc] = (len(ls), len(gone), None if text is None else "\n".join(x for i, x in enumerate(ls) if i not in gone))
    return out


def test_line_dedup_equals_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, t) for i, t in enumerate([*ODD, *("\n".join(rnd.choice("ab \n") * rnd.randint(0, 2) for _ in range(rnd.randint(0, 14))) for _ in range(60))])]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, key string, n_lines int").repartition(4)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.line_dedup(df).collect()}
    assert got == plain_lines(rows)
    assert line_dedup.line_dedup(df.limit(0)).collect() == []


def test_quality_base_counts(spark):
    rnd = random.Random(6)
    rows = [(i, t) for i, t in enumerate([*ODD, *(" ".join(rnd.choice("abc#") for _ in range(rnd.randint(0, 60))).replace("a b", "a\nb") for _ in range(60))])]
    labels = spark.createDataFrame([(20, 1, 0), (21, 1, 0), (22, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    df = frame(spark, rows)
    got = {r.doc_id: r for r in quality.quality(df, labels, ["doc_id"]).collect()}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        again = {p for k, w in enumerate(windows) if windows.count(w) > 1 for p in range(k, k + 5)}
        ls = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r._n_words, r._word_chars, r._n_symbols, r._n_dup_lines, r._n_repeat_words) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(ls) - len(set(ls)), len(again))
        assert r.base_failed == (len(words) < 10 or 100 * len(again) > 20 * len(words)) and not (r.kept and r.base_failed)
    assert quality.quality(df.limit(0), labels, ["doc_id"]).collect() == []
    assert quality.quality(df, labels.limit(0), ["doc_id"]).count() == len(rows)


def test_secret_scan_equals_plain_search_and_ledger(spark):
    hexes, key = "0123456789abcdef" * 3, "AKIA" + "ABCDEFGH12345678"
    samples = [None, "", "no secrets", f"password = hunter2222 and TOKEN:'abc' and api_key=\"{hexes}\"", key, key[:15], f"é{hexes} {key}", "secret: " + key, f"Passwd:x apikey=12345678 {hexes[:31]}"] * 2 + ["token=" + "a1" * 40_000]
    df = frame(spark, list(enumerate(samples)))
    found, ledger = secret_scan.secret_scan(df)
    patterns = {"assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}
    for r in found.collect():
        t, want = samples[r.doc_id] or "", []
        for k, (kind, p) in enumerate(patterns.items()):
            for m in p.finditer(t):
                if (kind == "assign" and len(m[2]) >= 8) or (kind == "access" and len(m[0]) >= 16) or (kind == "hex" and len(m[0]) >= 32):
                    want.append((m.start(), k, m.end()))
        assert [(s.start, s.ord, s.end) for s in r.findings if s.ord < 3] == sorted(want)
    assert ledger.count() == len({s or "" for s in samples})
    more = frame(spark, [(100, "new password=abcdefgh"), (101, samples[3])])
    again, after = secret_scan.secret_scan(more, ledger)
    assert after.count() == ledger.count() + 1 and {r.doc_id: len(r.findings) for r in again.collect()} == {100: 1, 101: 3}
    assert secret_scan.secret_scan(df.limit(0))[0].collect() == []
    clean = found.join(df.select("doc_id", "text"), "doc_id").select("doc_id", secret_scan.redacted(F.coalesce("text", F.lit("")), F.col("findings")).alias("t"))
    out = {r.doc_id: r.t for r in clean.collect()}
    assert out[4] == "[SECRET]" and out[6] == "é[SECRET] [SECRET]" and out[2] == "no secrets"


def test_top_k_equals_brute_force(spark):
    rnd = np.random.default_rng(8)
    vectors = [(i, v.tolist()) for i, v in enumerate(np.round(rnd.normal(0, 0.2, (400, 16)), 2))]
    vectors += [(500 + i, vectors[i % 3][1]) for i in range(20)] + [(450, None), (451, [float("nan")] * 16), (452, [None] * 16), (453, [float("inf")] * 16), (454, []), (0, vectors[0][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<float>, score int")
    rows = vector_search.vectors(df)
    found = vector_search.exact_top_k(rows, rows.where("vec_id % 50 = 0"))
    got = sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect())
    good = {i: np.floor(256 * np.pad(np.float32(v).astype(float), (0, 16 - len(v)))) for i, v in vectors if v is not None and None not in v and np.isfinite(v).all()}
    want = []
    for q in (i for i in good if i % 50 == 0):
        best = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert vector_search.exact_top_k(rows.limit(0), rows.limit(0)).collect() == []
    two = rows.where("vec_id in (50, 51)")
    assert vector_search.exact_top_k(two, two.where("vec_id = 50")).count() == 1


def test_toxicity_on_held_out_rows(spark):
    out = toxicity.op5_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    assert len(out) == 10_000 and out.score.between(0, 1).all()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id]).all()
    assert (out.predicted == (out.score >= 0.7)).all()
    m = out.merge(labels, on="doc_id")
    m = m[m.held_out]
    ranks = m.score.rank()
    n = m.toxic.sum()
    assert (ranks[m.toxic == 1].sum() - n * (n + 1) / 2) / (n * (len(m) - n)) > 0.97
    assert m[m.toxic == 0].predicted.mean() < 0.01 and m[m.toxic == 1].predicted.mean() > 0.85


def test_toxicity_edges(spark):
    df = frame(spark, list(enumerate(ODD)))
    labels = spark.createDataFrame([(1, 0), (2, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        model = toxicity.fit(df, known)
        assert [r.score for r in toxicity.score(df, model).collect()] == [0.0] * len(ODD)
    assert toxicity.score(df.limit(0), model).collect() == []


def test_isotonic_and_trees():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(2000, 3))
    y = (x[:, 0] + 0.3 * rnd.normal(size=2000) > 1).astype(float)
    trees = toxicity.boosted(x, y)
    margin = trees.margin(x)
    assert ((margin > 0) == (y == 1)).mean() > 0.93
    at, chance = toxicity.isotonic(margin, y)
    assert (np.diff(at) > 0).all() and (np.diff(chance) > 0).all() and abs(np.interp(margin, at, chance).mean() - y.mean()) < 0.05
