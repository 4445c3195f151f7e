import pytest

from quern.llm import vector_search


def found(spark, rows, k=5):
    df = vector_search.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    return sorted(tuple(r) for r in vector_search.exact_top_k(df, df.where("vec_id % 50 = 0"), k).collect())


def test_scores_beyond_doubles_are_exact(spark):
    big = float(2**22)
    rows = [(0, [big, big, 1.0, 1 / 256]), *((i, [big + i / 256, big - 1, float(i), -1.0]) for i in range(1, 60)), (70, [-big] * 4), (71, [1.0, 2.0, 3.0])]
    whole = {i: [int(256 * x) for x in v] + [0] * (4 - len(v)) for i, v in rows}
    want = []
    for q in (0, 50):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert min(-w[3] for w in want) < -(2**53) and found(spark, rows) == sorted(want)


def test_scores_beyond_64_bits_are_an_error(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [1.0, 1.0])]
    with pytest.raises(Exception, match="beyond 64 bits"):
        found(spark, rows)
    assert found(spark, [(0, [0.0]), (1, [1e300]), (2, [-1e300]), (3, [1.0])], 2) == [(0, 1, 1, 0), (0, 2, 2, 0)]
