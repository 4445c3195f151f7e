import random
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from quern.llm.common import dropped, marked, shared_folder, stored
from quern.llm.quality import passing, quality
from quern.llm.simhash import near_texts, parity, possible

SF = "/root/testdata/sf0.001"


def folders(spark):
    return set(Path(shared_folder(spark).replace("file:", "")).glob("*"))


def test_every_named_row_is_marked_and_few_others(spark):
    rows = spark.range(60_000).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("row"), "id").cache()
    names = stored(rows.where("id % 10 = 3").select("row"))
    found = marked(rows, names, "row")
    assert found.columns == ["row", "id", "_marked"] and found.count() == 60_000
    assert found.where("id % 10 = 3 and not _marked").isEmpty()
    assert found.where("id % 10 <> 3 and _marked").count() < 54_000 / 12
    assert marked(rows, names.limit(0), "row").where("_marked").isEmpty()
    dropped(names)
    assert not folders(spark) & {Path(f.replace("file:", "")).parent for f in names.inputFiles()}


def test_quality_rules_store_no_copy_of_the_texts(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    odd = docs.union(docs.limit(3)).union(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long"))).union(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    want = sorted(map(str, quality(odd, labels, pipeline.COLUMNS).where("kept").select(pipeline.COLUMNS).collect()))
    before = folders(spark)
    kept = passing(odd.select(pipeline.COLUMNS), labels)
    assert sorted(map(str, kept.collect())) == want and kept.columns == pipeline.COLUMNS
    assert folders(spark) == before


def test_near_texts_leave_no_sets_behind(spark):
    rnd = random.Random(5)
    base = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(400)) for _ in range(60)]
    rows = [(f"{i}-{k}".encode(), f"{t} end {k}") for i, t in enumerate(base) for k in range(5)]
    before = folders(spark)
    assert len({r.root for r in near_texts(spark.createDataFrame(rows, "row binary, text string")).collect()}) == 60
    read = [d for d in folders(spark) - before if d.name.startswith("table-")]
    assert not [d for d in read if "shingles" in spark.read.parquet(str(d)).columns or "shingle" in spark.read.parquet(str(d)).columns]


def test_parities_lose_no_similar_pair(spark):
    rnd = np.random.default_rng(6)
    sets, pairs, similar = [], [], set()
    for n in (1, 2, 4, 5, 9, 30, 100, 700, 5000):
        for gone in {0, 1, n // 9, n // 6, n // 3, n}:
            one = np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64))
            two = np.unique(np.concatenate([one[gone:], rnd.integers(0, 1 << 63, gone).astype(np.uint64)]))
            pairs.append((len(sets), len(sets) + 1))
            sets += [one, two]
            if 9 * len(np.intersect1d(one, two)) >= 4 * (len(one) + len(two)):
                similar.add(pairs[-1])
    nodes = spark.createDataFrame([(i, len(x), parity(x).tolist()) for i, x in enumerate(sets)], "node long, n int, parity array<long>")
    left = {(r.a, r.b) for r in possible(spark.createDataFrame(pairs, "a long, b long"), nodes).collect()}
    assert similar <= left and len(left) < len(pairs) - 10
