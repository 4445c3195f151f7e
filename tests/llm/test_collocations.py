import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import collocations as c
from tests.compare import sql_rows  # noqa: F401  (registered queries are compared in test_operators)

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, longest=3):
    counts = {}
    for lang, text in rows:
        of = counts.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(A_Z)):
            words = re.findall(r"[^\x20\x09]+", piece)
            of.update(tuple(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    return counts


def plain(rows, longest=3, least=10, share=50, top=2000):
    out = []
    for lang, f in plain_counts(rows, longest).items():
        n = sum(v for k, v in f.items() if len(k) == 1)
        candidates = {p: a for p, a in f.items() if len(p) >= 2 and a >= least}
        longer = Counter()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], a)
        found = []
        for p, a in candidates.items():
            if 100 * longer[p] >= share * a and longer[p]:
                continue
            score, _, l, r = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), a, l, r, n, score))
        out += [(lang, i, x[2].decode(), *x[3:]) for i, x in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def corpus(n=120, seed=3):
    rnd = random.Random(seed)
    words = ["The", "the", "new", "york", "times", "of", "Ünder", "a.b", "x", "日本", "\xa0odd", "\x00", "\x1cq", "Q!"]
    weights = [9, 9, 4, 4, 3, 7, 2, 1, 1, 1, 1, 1, 1, 1]
    make = lambda k: "".join(rnd.choice([" ", " ", " ", "\t", ", ", "\n", "  "]) + w for w in rnd.choices(words, weights, k=k))
    odd = [None, "", " ", "...", "\n\n", "word " * 3000, "a b\x0bc d\x0ce", "x" * 20_000]
    return [(rnd.choice(["en", "de", None, "und"]), t) for t in odd + [make(rnd.randint(0, 300)) for _ in range(n)]]


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "k", 1) for i, r in enumerate(rows)], "doc_id long, lang string, text string, phrase string, n int").repartition(3)


def taken(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("bits", [None, 16])
def test_equals_plain_counts(spark, bits):
    rows = corpus()
    rows += rows[:20]
    assert taken(c.collocations(frame(spark, rows), bits=bits)) == plain(rows)


def test_longer_phrases_and_small_tops(spark):
    rows = corpus(60, 5)
    assert taken(c.collocations(frame(spark, rows), longest=5, least=4, share=80, top=7)) == plain(rows, 5, 4, 80, 7)


def test_empty_table_and_texts_without_words(spark):
    assert taken(c.collocations(frame(spark, corpus()).limit(0))) == []
    assert taken(c.collocations(frame(spark, [("en", None), ("en", " \t "), (None, ".,")]))) == []


@pytest.mark.parametrize("limit,cut", [(1 << 20, 1 << 22), (50, 40), (1, 1), (7, 1000)])
def test_sections_lose_and_repeat_nothing(limit, cut):
    rows = corpus(40, 8)
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] or "und" for r in rows]), pa.array([(r[1] or "").encode() for r in rows])], ["lang", "text"])
    found = {}
    for held in c.sections(iter([batch]), 3, limit, cut):
        for lang, section in held.items():
            for numbers, counts, words in c.phrases(section, 3):
                for p, n in zip(zip(*(x.tolist() for x in numbers)), counts.tolist()):
                    found.setdefault(lang, Counter())[tuple(words[i].decode() for i in p)] += n
    assert found == {lang: f for lang, f in plain_counts(rows).items() if f or lang in found}


def test_sketch_counts_no_phrase_too_low_and_prunes(spark):
    rows = corpus(200, 4)
    df = frame(spark, rows).selectExpr("coalesce(lang, 'und') as lang", "cast(text as binary) as text").where("text is not null")
    bitmap = c.sketch(df, 3, 10, 16)
    passed = Counter()
    for lang, f in plain_counts(rows).items():
        for p, n in f.items():
            words = sorted(set(p))
            at = c.cells(lang, [np.array([words.index(w)]) for w in p], c.hashes([w.encode() for w in words]), 16)[:, 0]
            ok = all(bitmap[int(x) >> 3] >> (7 - int(x) % 8) & 1 for x in at)
            assert ok or n < 10
            passed[n >= 10, ok] += 1
    assert passed[False, False] > 5 * passed[False, True]


def test_scores_are_exact_beyond_64_bits(spark):
    a, b, ab = 999_999_999_999_989, 999_999_999_999_937, 999_999_999_999_431
    counts = spark.createDataFrame([("en", 1, "a", a), ("en", 1, "b", b), ("en", 2, "a b", ab)], "lang string, size int, phrase string, n long")
    assert [tuple(r) for r in c.scored(counts).collect()] == [("en", "a b", ab, a, b, 1000000 * ab * ab // (a * b))]
