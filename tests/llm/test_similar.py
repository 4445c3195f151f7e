import random

import corpus_pipeline as pipeline
from quern.llm.simhash import near_texts
from tests.llm.test_row_identity import documents


def plain_groups(texts):
    """The smallest index that chains of Jaccard(5 words) >= 0.8 reach."""
    sets = [{" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} for ws in ((t or "").lower().split() for t in texts)]
    at = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if at[i] != at[j] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                low, high = sorted((at[i], at[j]))
                at = [low if k == high else k for k in at]
    return at


def test_near_copies_equal_brute_force_jaccard(spark):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    passage = [rnd.choice(words) for _ in range(60)]
    texts = [None, "", " \n", "one", "ONE", "a b c d", "a b c d e"]
    for k in range(60):
        base = [rnd.choice(words) for _ in range(rnd.randint(10, 300))] + (passage if k % 2 else [])
        texts.append(" ".join(base))
        for _ in range(rnd.randint(1, 4)):
            base = list(base) if rnd.random() < 0.5 else base  # some edits go on from the one before
            for _ in range(rnd.randint(1, 5)):
                base[rnd.randrange(len(base))] = rnd.choice(words)
            texts.append(" ".join(base))
    groups = plain_groups(texts)
    assert 67 < len(set(groups)) < len(texts) - 50
    got = {r.doc_id for r in pipeline.near_copies(spark, documents(spark, enumerate(texts)), "").collect()}
    assert got == set(groups)


def test_the_chain_on_real_documents(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in pipeline.STAGES[:2]:
        docs = pipeline.stored(stage(spark, docs, sf_dir))
    before = sorted((r.doc_id, r.text) for r in docs.collect())
    groups = plain_groups([t for _, t in before])
    want = {before[k] for k in set(groups)}
    after = pipeline.stored(pipeline.near_copies(spark, docs, sf_dir))
    assert {(r.doc_id, r.text) for r in after.collect()} == want and after.count() == len(want)
    packed = pipeline.packing(spark, pipeline.secrets(spark, after, sf_dir), sf_dir)
    assert {r.doc_id for r in packed.collect()} == {i for i, _ in want}

def test_links_beyond_the_index_are_found(spark):
    """Short texts whose fingerprints lie far apart, and a group of more texts near each other than forests of links can try."""
    rnd = random.Random(4)
    word = lambda: f"w{rnd.randrange(10**9)}"
    texts = []
    for _ in range(150):  # a set of 8 or 9 shingles, of which 8 are the same
        base = [word() for _ in range(12)]
        texts += [" ".join(base), " ".join([*base, word()])]
    stem = [word() for _ in range(30)]
    for _ in range(40):  # near by fingerprint, but for pairs below 4/5
        own = list(stem)
        own[10], own[20] = word(), word()
        texts += [" ".join(own), " ".join([*own, word()])]
    groups = plain_groups(texts)
    assert len(set(groups)) == len(texts) // 2
    rows = [(str(i).encode(), t) for i, t in enumerate(texts)]
    found = near_texts(spark.createDataFrame(rows, "row binary, text string")).collect()
    first = {}
    for r in sorted(found, key=lambda r: int(r.row)):
        first.setdefault(r.root, int(r.row))
    assert {int(r.row): first[r.root] for r in found} == dict(enumerate(groups))
