import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quern.llm import manifest as m


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, more=0):
    row = [row["doc_id"], row["source"], row["lang"], None if row["n_chars"] is None else row["n_chars"] + more, row["text"]]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes, fanout):
    """(root, steps of each node)"""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, s in enumerate(steps):
            i = at[k] // fanout * fanout
            s.append(("".join(nodes[i : at[k]]), "".join(nodes[at[k] + 1 : i + fanout])))
            at[k] //= fanout
        nodes = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], steps


def plain(rows, fanout=2):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    done = {}
    for lang in langs:
        groups[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        done[lang] = plain_tree([plain_leaf(r) for r in groups[lang]], fanout)
    root, above = plain_tree([done[x][0] for x in langs], fanout) if langs else (None, [])
    out = []
    for lang, up in zip(langs, above):
        for r, own in zip(groups[lang], done[lang][1]):
            changed = r["doc_id"] is not None and r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            end = plain_leaf(r, int(changed))
            for before, after in own + up:
                end = h(before, end, after)
            out.append((r["doc_id"], plain_leaf(r), done[lang][0], root, h(*(a + b for a, b in own + up)), end, end == root))
    return sorted(out, key=str)


def documents(n, langs, seed=1):
    rnd = random.Random(seed)
    rows = [{"doc_id": rnd.choice([i, i, i, 5, None, 10**17 + i]), "source": rnd.choice([None, "web", "ü|:-"]), "lang": rnd.choice(langs), "n_chars": rnd.choice([None, i, 2**63 - 1]), "text": rnd.choice([None, "", "a\nb", "日本|" * i])} for i in range(n)]
    return rows + rows[: n // 5]


def digests(spark, rows, fanout=2, levels=2):
    df = spark.createDataFrame([(*r.values(), "x", 3) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, place int").repartition(3)
    made = m.manifest(m.document_leaves(df), "doc_id", "lang", "leaf", ("changed",), fanout, levels)
    found = made.select("doc_id", "leaf", "subroot", "root", F.sha2(m.siblings(F.col("steps")), 256), m.folded(F.coalesce("changed", "leaf"), F.col("steps")).alias("end"))
    return sorted((tuple(r) for r in found.withColumn("ok", F.col("end") == F.col("root")).collect()), key=str)


@pytest.mark.parametrize("langs,fanout,levels", [(["en"], 2, 2), ([None, "", "en", "de", "Ä", "z"], 2, 3), (["en", None], 3, 1), ([f"l{i}" for i in range(40)], 4, 2)])
def test_equals_a_plain_tree(spark, langs, fanout, levels):
    rows = documents(70, langs)
    assert digests(spark, rows, fanout, levels) == plain(rows, fanout)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, n):
    rows = documents(n, ["en"], n)
    assert digests(spark, rows) == plain(rows)


def test_one_row_a_group(spark):
    rows = [{"doc_id": i, "source": None, "lang": f"l{i}", "n_chars": i, "text": "t"} for i in range(9)]
    assert digests(spark, rows) == plain(rows)


def test_no_bucket_holds_more_than_its_width(spark):
    """Whatever the size of a tree, rounds go by bucket, and places are gapless."""
    rows = spark.range(500).select(F.lit("=en").alias("tree"), F.col("id").alias("_key"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), F.col("id").alias("_row"))
    ranked = m.ranked(rows, "tree", ["_key", "digest", "_row"])
    assert [r.place for r in ranked.orderBy("_key").collect()] == list(range(500))
    rounds = m.trees(ranked, 2, 3)
    assert [x.count() for x in rounds] == [500, 63, 8, 1]
