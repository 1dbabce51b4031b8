from fractions import Fraction

import numpy as np
import pytest

from quire.llm import whitening as W


def whole(vecs):
    return [[int(np.floor(1024 * float(c))) + 100000 for c in v] for v in vecs]


def exact(rows):
    """(sums, covariance as floats, deviations) in whole numbers."""
    n, d = len(rows), len(rows[0])
    s = [sum(r[i] for r in rows) for i in range(d)]
    gap = [[n * r[i] - s[i] for i in range(d)] for r in rows]
    cov = [[float(Fraction(sum(g[i] * g[j] for g in gap), n**3)) for j in range(d)] for i in range(d)]
    return s, np.array(cov), [sum(v * v for v in g) for g in gap]


def check(got, ids, rows, k):
    n = len(rows)
    s, cov, dev = exact(rows)
    value, unit = np.linalg.eigh(cov)
    value, unit = value[::-1], unit[:, ::-1]
    seen = {}
    for r in got:
        seen.setdefault(r.vec_id, {})[r.component] = r
    assert set(seen) == set(ids) and all(sorted(v) == list(range(1, k + 1)) for v in seen.values())
    x = np.array([[float(Fraction(v) - Fraction(t, n)) for v, t in zip(r, s)] for r in rows])
    for c in range(k):
        want = x @ unit[:, c] / np.sqrt(value[c])
        mine = np.array([seen[i][c + 1].whitened for i in ids])
        mine *= np.sign(mine @ want)
        assert np.abs(mine - want).max() < 1e-6
        for i, v in zip(ids, dev):
            r = seen[i][c + 1]
            assert r.deviation == v and r.n == n and r.distance2 == pytest.approx(v / n / n)
            assert r.explained == pytest.approx(value[c] / np.trace(cov), rel=1e-9) and r.identity_error < 1e-8


@pytest.mark.parametrize("kind,d", [("float", 12), ("double", 5)])
def test_equals_exact_arithmetic(spark, kind, d):
    rng = np.random.default_rng(d)
    vecs = rng.standard_normal((120, d)) @ np.diag(np.linspace(3, 0.2, d)) + rng.standard_normal(d) * 50
    vecs = vecs.astype(np.float32).astype(float)
    ids = [2**53 + 1 + i for i in range(119)] + [2**63 - 1]
    df = spark.createDataFrame([(i, v.tolist(), 0, 1.0) for i, v in zip(ids, vecs)],
                               f"vec_id long, embedding array<{kind}>, component int, w double").repartition(5)
    check(W.whiten(df).collect(), ids, whole(vecs), min(d, 8))


def test_unusable_rows_null_ids_ties_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.5, -1.0, 2.0], [1.5, 0.25, 0.0], [0.5, -1.0, 2.0], [-3.0, 4.0, 1.0], [9.0, 2.0, -7.0]]
    ids = [2**53 + 1, None, 2**53 + 1, 7, 2**63 - 1]
    rows = [*zip(ids, good), (1, None), (2, []), (3, [1.0, nan, 0.0]), (4, [inf, 0.0, 0.0]), (5, [None, 0.0, 1.0]), (6, [1.0, 2.0])]
    got = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    _, cov, dev = exact(whole(good))
    assert sorted((r.vec_id or 0, r.deviation) for r in got if r.component == 1) == sorted((i or 0, v) for i, v in zip(ids, dev))
    assert {r.component for r in got} == {1, 2, 3} and {r.n for r in got} == {5}
    assert sum({r.component: r.explained for r in got}.values()) == pytest.approx(1)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    df = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert df.collect() == [] and df.columns[:4] == ["vec_id", "component", "n", "deviation"]


def test_vectors_without_spread_in_some_direction(spark):
    df = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(10)], "vec_id long, embedding array<float>")
    got = W.whiten(df).collect()
    assert len(got) == 10 and all(r.explained == pytest.approx(1) and r.identity_error < 1e-9 for r in got)


def test_huge_entries_and_deviations_beyond_a_long(spark):
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [3e9, 2.0]), (4, [0.0, -1.0])]
    got = {(r.vec_id, r.component): r for r in W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(np.isfinite(r.whitened) for r in got.values())
    assert got[1, 1].deviation is None and got[1, 1].distance2 > 1e36


def test_limbs_and_sums_are_exact():
    rng = np.random.default_rng(0)
    y = rng.integers(-(1 << 62), 1 << 62, (700, 3))
    s = W.Sums()
    part = W.limbs(y)
    for k, a in enumerate(part):
        for m, b in enumerate(part):
            s.add(k + m, a.T @ b)
    total = sum(v * (1 << (21 * level)) for level, v in s.items())
    assert (total == y.astype(object).T @ y.astype(object)).all()


def test_factorisation_of_graded_matrices():
    rng = np.random.default_rng(1)
    for d in (1, 2, 7, 40):
        q, _ = np.linalg.qr(rng.standard_normal((d, d)))
        want = np.logspace(6, -3, d)
        value, unit = W.principal((q * want) @ q.T)
        assert np.allclose(value, want, rtol=1e-6) and np.abs(unit.T @ unit - np.eye(d)).max() < 1e-12


def test_whole_table_has_unit_covariance(spark):
    got = W.op13_embedding_whitening(spark, "/root/testdata/sf0.001").toPandas()
    wide = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(np.cov(wide.T, bias=True) - np.eye(wide.shape[1])).max() < 1e-8
