import corpus_pipeline as pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [r[1] for r in pipeline.STAGES]
    for stage in kept[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = pipeline.stored(stage(spark, docs, sf_dir))
        assert docs.columns == pipeline.COLUMNS and docs.where("n_chars <> length(text)").isEmpty()
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before) and len(after) == docs.count()
    packed = kept[-1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.collect()} == set(after)
    assert pipeline.run(spark, sf_dir).count() == packed.count()


def test_odd_rows(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, words, None, None, None), (1, words, None, None, None), (2, words + " password=abcdefgh1", "en", "s", 3), (3, None, "en", "s", 0), (None, words.upper(), "en", "s", 1), (4, "", None, "s", 1)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], COLUMNS + ", _stays int").coalesce(2)
    copies = pipeline.near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in copies.where("text is not null and text <> ''").collect() if r.doc_id is not None)[0] == 1
    assert copies.where("doc_id = 1").count() == 1
    redacted = {r.text for r in pipeline.secrets(spark, docs, "").collect()}
    assert words + " [SECRET]" in redacted and None in redacted
    assert pipeline.repeated_lines(spark, docs, "").count() == 6
    assert pipeline.packing(spark, docs, "").count() == 6
    for stage in (pipeline.near_copies, pipeline.secrets, pipeline.repeated_lines):
        assert stage(spark, docs.limit(0), "").collect() == []
