"""Whitening against NumPy on the whole matrix."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from listwright.llm import op12_whitening as op

SF = "/root/testdata/sf0.001"


def plain(x):
    """n, exact deviations, eigenvalues, components, projections of integer vectors (Python's integers)."""
    n = len(x)
    sums = [sum(c) for c in zip(*x)]
    shifted = [[n * v - s for v, s in zip(row, sums)] for row in x]
    c = np.array([[v / n for v in row] for row in shifted])
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1][:32], axes[:, ::-1][:, :32]
    return n, [sum(v * v for v in row) for row in shifted], values, float(np.trace(c.T @ c / n)), c @ axes


def test_query_equals_numpy(spark):
    import __spark_entry__ as entry

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, deviation, values, trace, projected = plain([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows])
    got = {(r.vec_id, r.component): r for r in entry.queries()["op12_whitened_embeddings"](spark, SF).collect()}
    assert len(got) == 32 * n and {r.n for r in got.values()} == {n}
    place = {i: k for k, (i, _) in enumerate(rows)}
    for (i, _), r in got.items():
        assert r.deviation == deviation[place[i]]
    for c in range(32):
        mine = np.array([got[i, c + 1].whitened for i, _ in rows])
        want = projected[:, c] / math.sqrt(values[c])
        assert np.abs(mine * np.sign(mine @ want) - want).max() < 1e-9
        assert abs(got[rows[0][0], c + 1].explained - values[c] / trace) < 1e-12
    errors = {r.identity_error for r in got.values()}
    assert len(errors) == 1 and errors.pop() < 1e-9
    white = np.array([[got[i, c + 1].whitened for c in range(32)] for i, _ in rows])
    assert np.abs(np.cov(white.T, bias=True) - np.eye(32)).max() < 1e-9


@pytest.fixture
def odd(spark):
    rng = np.random.default_rng(3)
    data = [(i, [float(v) for v in rng.normal(size=3)], 1) for i in range(40)]
    data += [(100, None, 1), (101, [1.0, None, 2.0], 1), (102, [1.0, float("nan"), 2.0], 1), (103, [1.0, float("inf"), 2.0], 1), (104, [], 1), (105, [1.0, 2.0], 1), (106, [1e30, 0.0, 0.0], 1)]
    data += [(None, [0.5, 0.5, 0.5], 1), (3, data[3][1], 1)]
    return spark.createDataFrame(data, "vec_id long, embedding array<double>, n int").withColumn("component", F.lit(0))


def test_odd_rows(spark, odd):
    for k in (1, 9):
        got = op.whitened(odd.repartition(k)).collect()
        assert {r.n for r in got} == {42} and len(got) == 42 * 3 and {r.component for r in got} == {1, 2, 3}
        assert not {100, 101, 102, 103, 104, 105, 106} & {r.vec_id for r in got} and sum(r.vec_id is None for r in got) == 3 == sum(r.vec_id == 3 for r in got) / 2
        assert abs(sum(r.explained for r in got) - 42) < 1e-9
    assert op.whitened(odd.where("vec_id between 100 and 104")).collect() == [] and op.whitened(odd.where("1 = 0")).collect() == []


def test_without_variance(spark):
    df = spark.createDataFrame([(i, [float(i % 4), 1.0, 1.0]) for i in range(12)], "vec_id long, embedding array<float>")
    got = op.whitened(df).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in got) and all(r.explained == (r.component == 1) for r in got)
    assert max(r.identity_error for r in got) < 1e-12
    one = op.whitened(df.where("vec_id = 5")).collect()
    assert [(r.whitened, r.deviation, r.identity_error, r.explained) for r in one] == [(None, 0, 0.0, 0.0)] * 3


def test_large_entries_are_exact(spark):
    data = [(i, [float(2**50 + 3 * i), float(i * i)]) for i in range(9)]
    got = op.whitened(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    n, deviation, *_ = plain([[64 * int(c) + 1_000_000 for c in v] for _, v in data])
    assert {r.vec_id: r.deviation for r in got} == dict(enumerate(deviation))
    # beyond the range of a long there is no number to give
    far = op.whitened(spark.createDataFrame([(0, [0.0]), (1, [2.0**50])], "vec_id long, embedding array<double>")).collect()
    assert [r.deviation for r in far] == [None, None] and sorted(r.whitened for r in far) == [-1.0, 1.0]
