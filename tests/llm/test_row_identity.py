import corpus_pipeline as pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS).repartition(3)


def test_unlinked_texts_without_or_with_shared_ids_all_stay(spark):
    text = [" ".join(f"{k}{i}" for i in range(40)) for k in "abcdef"]
    rows = [(None, text[0]), (None, text[1]), (None, text[1]), (None, text[2]), (7, text[3]), (7, text[4]), (7, text[4]), (8, text[5]), (9, text[5]), (None, text[5])]
    kept = pipeline.near_copies(spark, documents(spark, rows), "").collect()
    assert sorted((str(r.doc_id), r.text[0]) for r in kept) == [("7", "d"), ("7", "e"), ("8", "f"), ("None", "a"), ("None", "b"), ("None", "c")]
