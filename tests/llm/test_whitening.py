"""Whitening against exact fractions, NumPy, and vectors of every bad kind."""

from fractions import Fraction

import numpy as np
import pytest

from veritide.llm import whitening as W


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, n int, component string")


def integers(vectors):
    return [[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors]


def test_products_of_limbs_are_exact():
    rng = np.random.default_rng(3)
    for bits in (3, 19, 20, 21, 40, 59):
        d = rng.integers(-(1 << bits), 1 << bits, size=(W.ROWS, 5))
        whole = d.astype(object)
        assert (W.exact_gram(d) == whole.T @ whole).all()
    huge = np.array([[3**70, -(7**40)], [-(5**50), 11]], dtype=object)
    assert (W.exact_gram(huge) == huge.T @ huge).all()


def test_covariance_is_exact(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(300, 4)) * [1, 1e3, 1e9, 1e14]).tolist()
    rows = frame(spark, [(i, v, 1, "x") for i, v in enumerate(vectors)]).repartition(5)
    x = np.array(integers(vectors), dtype=object)
    centre = W._centre(rows.select("embedding"))
    assert (centre.n, centre.sums) == (300, [int(s) for s in x.sum(axis=0)])
    d = 300 * x - x.sum(axis=0)
    assert (W.covariance_sums(rows.select("embedding"), centre) == d.T @ d).all()


def test_query_against_numpy(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    source = {r["vec_id"]: list(r["embedding"]) for r in table.collect()}
    ids = sorted(source)
    x = np.array(integers([source[i] for i in ids]), dtype=object)
    n, s = len(x), x.sum(axis=0)
    d = n * x - s
    v = np.array([[float(Fraction(int(c), n**3)) for c in row] for row in d.T @ d])
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    want = (d / n).astype(float) @ q[:, :32] / np.sqrt(e[:32])
    rows = sorted(W.whiten(table).collect(), key=lambda r: (r["vec_id"], r["component"]))
    assert [(r["vec_id"], r["component"]) for r in rows] == [(i, k) for i in ids for k in range(1, 33)]
    assert [r["deviation"] for r in rows[::32]] == [int(z) for z in (d**2).sum(axis=1)] and {r["n"] for r in rows} == {n}
    got = np.array([r["whitened"] for r in rows]).reshape(-1, 32)
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got * sign - want).max() < 1e-8
    assert np.array([r["explained"] for r in rows[:32]]) == pytest.approx(e[:32] / e.sum(), rel=1e-9)
    [error] = {r["identity_error"] for r in rows}
    assert error < 1e-9 and np.abs(np.cov(got.T, bias=True) - np.eye(32)).max() < 1e-9


def test_small_eigenvalues_keep_their_digits(spark):
    """Independent dimensions of very unlike spread: each component is one dimension, scaled by its own deviation."""
    rng = np.random.default_rng(7)
    vectors = (np.sign(rng.normal(size=(64, 3))) * [1e6, 1e3, 1]).tolist()
    rows = W.whiten(frame(spark, [(i, v, 1, "x") for i, v in enumerate(vectors)])).collect()
    x = np.array(integers(vectors), dtype=object)
    d = (64 * x - x.sum(axis=0)).tolist()
    v = [[Fraction(sum(a[i] * a[j] for a in d), 64**3) for j in range(3)] for i in range(3)]
    det = v[0][0] * (v[1][1] * v[2][2] - v[1][2] ** 2) - v[0][1] * (v[0][1] * v[2][2] - v[1][2] * v[0][2]) + v[0][2] * (v[0][1] * v[1][2] - v[1][1] * v[0][2])
    shares = {r["component"]: r["explained"] for r in rows}
    trace = float(v[0][0] + v[1][1] + v[2][2])
    assert np.prod([shares[k] for k in (1, 2, 3)]) * trace**3 == pytest.approx(float(det), rel=1e-6)
    assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]} and rows[0]["identity_error"] < 1e-6


def test_bad_vectors_go(spark):
    good = [(i, [float(i), float(i * i % 7), 1.0], 1, "x") for i in range(20)]
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [float("nan"), 0.0, 0.0]), (94, [0.0, float("-inf"), 0.0]), (95, [1.0, 2.0])]
    rows = W.whiten(frame(spark, good + [(*b, 2, "y") for b in bad])).collect()
    assert sorted((r["vec_id"], r["component"]) for r in rows) == [(i, k) for i in range(20) for k in (1, 2)]
    assert {r["n"] for r in rows} == {20}
    again = W.whiten(frame(spark, [*good, good[0], (None, *good[1][1:])])).collect()
    assert {r["n"] for r in again} == {22} and sum(r["vec_id"] == 0 for r in again) == 4 and sum(r["vec_id"] is None for r in again) == 2


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0], 1, "x")], [(i, [3.0, 3.0], 1, "x") for i in range(5)]])
def test_nothing_to_whiten(spark, rows):
    assert W.whiten(frame(spark, rows)).collect() == []


def test_far_entries(spark):
    rows = W.whiten(frame(spark, [(1, [1e300, 0.0], 1, "x"), (2, [-1e300, 1.0], 1, "x"), (3, [5.0, -1.0], 1, "x")])).collect()
    assert {(r["component"]) for r in rows} <= {1, 2} and {r["deviation"] for r in rows if r["vec_id"] == 1} == {None}
    assert all(r["identity_error"] < 1e-4 for r in rows)
