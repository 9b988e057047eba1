import math
from fractions import Fraction

import numpy as np
import pytest

from sitewatch.llm import whitening as wh
from sitewatch.llm.wholes import whole_vectors

ODD = [(900, None), (901, [float("nan")] * 6), (902, [float("inf")] * 6), (903, [None] + [1.0] * 5), (904, [])]


def frame(spark, rows, parts=3):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, whitened string, n int")
    return df.repartition(parts) if rows else df


def write(df, tmp_path):
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def brute(rows):
    """n, the deviations and the covariance, in fractions."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    n, s = len(x), [sum(c) for c in zip(*x)]
    away = [[n * c - t for c, t in zip(r, s)] for r in x]
    cov = [[float(Fraction(sum(r[i] * r[j] for r in away), n ** 3)) for j in range(len(s))] for i in range(len(s))]
    return n, [sum(c * c for c in r) for r in away], np.array(away, dtype=object), np.array(cov)


def check(got, rows, wanted=32):
    n, deviation, away, cov = brute(rows)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(wanted, int((values > 1e-12 * max(values[0], 1e-300)).sum()))
    assert {r["component"] for r in got} == set(range(1, k + 1)) and len(got) == k * len(rows)
    assert {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) <= 1
    by = {}
    for r in got:
        by.setdefault(r["component"], {})[r["vec_id"]] = r
    place = {i: p for p, (i, _) in enumerate(rows)}
    exact = (away / n).astype(float)
    for c, found in by.items():
        white = exact @ vectors[:, c - 1] / math.sqrt(values[c - 1])
        mine = np.array([found[i]["whitened"] for i, _ in rows])
        assert all(found[i]["deviation"] == deviation[place[i]] for i, _ in rows)
        assert abs(found[rows[0][0]]["explained"] / (values[c - 1] / np.trace(cov)) - 1) < 1e-10
        assert abs(float(mine @ mine) / n - 1) < 1e-9
        gap = min((abs(values[c - 1] - v) for j, v in enumerate(values) if j != c - 1), default=values[0]) / values[0]
        if gap > 1e-6:
            assert min(np.abs(mine - white).max(), np.abs(mine + white).max()) < 1e-13 / gap * 10 + 1e-12
    assert all(r["identity_error"] < 1e-9 for r in got)


def vectors(n, dim, seed=1):
    rnd = np.random.default_rng(seed)
    mix = rnd.standard_normal((dim, dim))
    return [(i, [float(x) for x in v]) for i, v in enumerate((rnd.standard_normal((n, dim)) @ mix * 3 + 5).tolist())]


@pytest.mark.parametrize("n, dim", [(200, 6), (150, 48), (20, 40), (3, 5), (2, 1)])
def test_equals_dense_solver(spark, tmp_path, n, dim):
    rows = vectors(n, dim)
    got = wh.op12_whitening(spark, write(frame(spark, rows + ODD), tmp_path)).collect()
    check([r for r in got if r["vec_id"] < 900], rows)
    assert not [r for r in got if r["vec_id"] >= 900]


def test_equal_eigenvalues(spark, tmp_path):
    """Axes of equal spread, and an entry without any."""
    rows = [(2 * i + s, [(1.0 if s else -1.0) * (j == i) * (1 if i < 5 else 3) for j in range(8)] + [7.0]) for i in range(8) for s in (0, 1)]
    got = wh.op12_whitening(spark, write(frame(spark, rows), tmp_path)).collect()
    check(got, rows)


def test_large_numbers(spark, tmp_path):
    rnd = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rnd.standard_normal((40, 4)) * 1e8)]
    n, deviation, _, _ = brute(rows)
    assert max(deviation) > 2 ** 63
    got = wh.op12_whitening(spark, write(frame(spark, rows), tmp_path)).collect()
    assert {(r["vec_id"], r["deviation"]) for r in got} == {(i, d if d < 2 ** 63 else None) for (i, _), d in zip(rows, deviation)}
    assert len(got) == 160 and all(r["identity_error"] < 1e-9 for r in got)


def test_nothing_one_row_and_equal_rows(spark, tmp_path):
    assert wh.op12_whitening(spark, write(frame(spark, []), tmp_path / "a")).collect() == []
    assert wh.op12_whitening(spark, write(frame(spark, ODD), tmp_path / "b")).collect() == []
    assert wh.op12_whitening(spark, write(frame(spark, [(1, [1.0, 2.0])] * 4), tmp_path / "c")).collect() == []


def test_lengths_are_fits_of_their_own(spark, tmp_path):
    a, b = vectors(30, 3), [(i + 100, v) for i, v in vectors(25, 4, seed=4)]
    got = wh.op12_whitening(spark, write(frame(spark, a + b), tmp_path)).collect()
    check([r for r in got if r["vec_id"] < 100], a)
    check([r for r in got if r["vec_id"] >= 100], b)


def symmetric(values, seed=3):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * np.array(values)) @ q.T


def test_inertia_counts_and_intervals():
    values = [9.0, 8.999999999, 5.0, 4.0, 4.0, 4.0, 1.0, 1e-3, 1e-9, 0.0]
    tri = wh.tridiagonal(symmetric(values))
    assert wh.count_above(tri, np.array([10.0, 8.0, 4.5, 2.0, 0.5, 1e-4, -1.0])).tolist() == [0, 2, 3, 6, 7, 8, 10]
    for wanted in range(1, 9):
        parts = wh.intervals(tri, wanted)
        assert wanted <= sum(p.count for p in parts) <= 10
        assert all(a.low == b.high for a, b in zip(parts, parts[1:]))


@pytest.mark.parametrize("values", [list(range(1, 65)), [1e6] * 3 + [1.0] * 40 + [1e-3] * 7, [2.0 ** -i for i in range(40)]])
def test_contours_miss_no_eigenvalue(spark, values):
    v = symmetric(values)
    found, rows = wh.eigenpairs(spark, v, 32)
    want = np.sort(np.linalg.eigvalsh(v))[::-1][:len(found)]
    assert len(found) == min(32, int((want > len(v) * 2.0 ** -50 * want[0]).sum()))
    assert np.abs(found - want).max() < 1e-13 * want[0] * len(v)
    assert np.abs(rows @ rows.T - np.eye(len(rows))).max() < 1e-13
    assert np.linalg.norm(v @ rows.T - rows.T * found, axis=0).max() < 1e-13 * want[0] * len(v)


def test_projection_keeps_the_interval_alone():
    v = symmetric([10.0, 9.0, 5.0, 1.0])
    got = wh.project(v, wh.Interval(7.0, 12.0, 2), np.eye(4))
    values, vectors = np.linalg.eigh(v)
    assert np.abs(got - vectors[:, 2:] @ vectors[:, 2:].T).max() < 1e-3


def test_whole_vectors(spark):
    df = frame(spark, [(1, [-0.01, 0.5]), (None, [1.0, 2.0]), (2, [2.0 ** 50, 0.0])] + ODD)
    rows = {(r["id"], tuple(r["v"])) for r in whole_vectors(df, "vec_id", "embedding", 64).collect()}
    assert rows == {(1, (-1, 32)), (None, (64, 128)), (904, ())}
