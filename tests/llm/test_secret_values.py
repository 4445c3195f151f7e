import corpus_pipeline as pipeline
from quern.llm import secret_scan

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_assign_counts_the_value_alone(spark):
    short = ["password=abc", "token=None", "api_key=x1", "secret==abcdef", 'PASSWORD = "short1"', "passwd=1234567"]
    full = [("password=abcdefgh", 17), ("token==abcdefg", 14), ("API_KEY: '12345678'", 18), ("secret=12345678 token=None", 15)]
    rows = [(t, []) for t in short] + [(t, [("assign", 0, end)]) for t, end in full]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, (t, _) in enumerate(rows)], COLUMNS)
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.findings] for r in secret_scan.secret_scan(df)[0].collect()}
    assert found == {i: want for i, (_, want) in enumerate(rows)}
    redacted = {r.doc_id: r.text for r in pipeline.secrets(spark, df, "").collect()}
    assert redacted[1] == "token=None" and redacted[9] == "[SECRET] token=None"


def test_texts_without_a_key_are_scanned(spark):
    rows = [(None, "password=abcdefgh"), (None, "password=abcdefgh"), (None, "token=12345678"), (1, "token=12345678"), (None, "clean"), (2, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], COLUMNS)
    found, ledger = secret_scan.secret_scan(df)
    assert sorted((str(r.doc_id), len(r.findings)) for r in found.collect()) == [("1", 1), ("2", 0), ("None", 0), ("None", 1), ("None", 1), ("None", 1)]
    assert ledger.count() == 4
    assert sorted(str(r.text) for r in pipeline.secrets(spark, df, "").collect()) == ["None", *["[SECRET]"] * 4, "clean"]
