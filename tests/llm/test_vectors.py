import numpy as np
import pytest

from stanzaflow.llm import vectors


def slow(ids, x, k, least=-2.0):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i, d in enumerate(ids):
        s = u @ u[i]
        best = sorted((-round(float(s[j]), 9), ids[j]) for j in range(len(ids)) if j != i)[:k]
        out[d] = [(b, -a) for a, b in best if -a >= least]
    return out


def result(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r["id"], []).append((r["neighbour"], round(r["similarity"], 9)))
    return out


def data(n=700, dim=8, seed=0):
    r = np.random.default_rng(seed)
    return list(range(n)), r.normal(size=(n // 10, dim)).repeat(10, axis=0) + 0.2 * r.normal(size=(n, dim))


@pytest.mark.parametrize("least", [None, 0.97])
def test_exact_with_many_shards(spark, least):
    ids, x = data()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "doc_id bigint, features array<double>")
    got = result(vectors.nearest(df, k=4, min_similarity=least, sample=400, shard_rows=70))
    want = {d: v for d, v in slow(ids, x, 4, -2 if least is None else least).items() if v}
    assert {d: [s for _, s in v] for d, v in got.items()} == {d: [s for _, s in v] for d, v in want.items()}
    assert got == want


def test_relaxed_recall_of_a_query_set(spark):
    ids, x = data(1500, 12, 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "doc_id bigint, features array<double>")
    got = result(vectors.nearest(df, k=10, relax=0.5, queries="id % 100 = 0", sample=600, shard_rows=100))
    want = slow(ids, x, 10)
    assert set(got) == {i for i in ids if i % 100 == 0}
    hit = sum(len({a for a, _ in got[d]} & {a for a, _ in want[d]}) for d in got)
    assert hit >= 0.9 * 10 * len(got)


def test_copies_dirt_and_clashing_columns(spark):
    good = [(i, [1.0, 0.0, 0.0]) for i in range(30)] + [(100, [0.9, 0.1, 0.0]), (101, [0.0, 1.0, 0.0])]
    bad = [(200, None), (201, []), (202, [0.0, 0.0, 0.0]), (203, [float("nan"), 1.0, 0.0]), (204, [None, 1.0, 0.0]), (205, [float("inf"), 0.0, 0.0]), (206, [1.0, 2.0]), (None, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in good + bad + good[:5]], "doc_id bigint, features array<double>, id int, u string")
    got = result(vectors.nearest(df, k=3))
    assert set(got) == {i for i, _ in good}
    assert [a for a, _ in got[0]] == [1, 2, 3] and [a for a, _ in got[2]] == [0, 1, 3] and [a for a, _ in got[29]] == [0, 1, 2]
    assert [a for a, _ in got[100]] == [0, 1, 2] and got[101][0][0] == 100


def test_levels_keep_shards_of_block_size(spark):
    """Routers of two shards each: many levels, and still exact."""
    ids, x = data(600, 6, 4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "doc_id bigint, features array<double>")
    got = result(vectors.nearest(df, k=3, sample=64, shard_rows=20))
    assert got == slow(ids, x, 3)


def test_equal_distances_are_cut_by_hash(spark):
    """Unit axes: all distances are equal, so no vantage point can part them."""
    df = spark.createDataFrame([(i, np.eye(120)[i].tolist()) for i in range(120)], "doc_id bigint, features array<double>")
    got = result(vectors.nearest(df, k=2, sample=64, shard_rows=15))
    assert len(got) == 120 and got[50] == [(0, 0.0), (1, 0.0)] and got[0] == [(1, 0.0), (2, 0.0)]


def test_lengths_are_searched_apart(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.0, 0.0]), (4, [0.9, 0.0, 0.1]), (5, [1.0])]
    got = result(vectors.nearest(spark.createDataFrame(rows, "doc_id bigint, features array<double>"), k=3))
    assert {d: [b for b, _ in v] for d, v in got.items()} == {1: [2], 2: [1], 3: [4], 4: [3]}


def test_few_rows(spark):
    schema = "doc_id bigint, features array<double>"
    assert vectors.nearest(spark.createDataFrame([], schema)).count() == 0
    assert vectors.nearest(spark.createDataFrame([(1, [1.0])], schema)).count() == 0
    assert result(vectors.nearest(spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], schema), k=5)).keys() == {1, 2}
