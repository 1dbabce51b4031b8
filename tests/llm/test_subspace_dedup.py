import numpy as np
import pytest

from quire.llm import subspace_dedup as S


def brute(ids, labels, vecs, cosine=0.98):
    n = len(ids)
    x = np.array(vecs, float)
    norm = np.sqrt((x * x).sum(axis=1))
    c = (x @ x.T) / np.outer(norm, norm)
    link = (c >= cosine) & (np.array(labels)[:, None] == np.array(labels)[None, :]) & ~np.eye(n, dtype=bool)
    low = np.arange(n)
    low = S.forest(n, *np.nonzero(link))
    best = {}
    for i, r in enumerate(low):
        best[r] = min(best.get(r, ids[i]), ids[i])
    return {(ids[i], int(link[i].sum()), best[low[i]], best[low[i]] == ids[i]) for i in range(n)}


def clustered(n, d, seed):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((6, d))
    out = []
    for i in range(n):
        kind = rng.integers(0, 10)
        if kind < 6:
            out.append(centre[kind] + rng.standard_normal(d) * rng.choice([0.03, 0.08, 0.14]))
        elif kind < 8 and out:
            out.append(out[rng.integers(len(out))] * rng.choice([1.0, 2.5]))
        else:
            out.append(rng.standard_normal(d))
    return np.array(out)


@pytest.mark.parametrize("kind,d,chunk", [("float", 64, 512), ("double", 10, 16), ("float", 3, 32)])
def test_links_and_classes_equal_brute_force(spark, kind, d, chunk):
    x = clustered(300, d, d)
    if kind == "float":
        x = x.astype(np.float32).astype(float)
    ids, labels = [int(i) * 3 % 1000 for i in range(300)], [int(i) % 3 // 2 for i in range(300)]
    df = spark.createDataFrame([(i, v.tolist(), lab, 0) for i, v, lab in zip(ids, x, labels)],
                               f"vec_id long, embedding array<{kind}>, label int, cell int")
    got = {tuple(r) for r in S.near_vectors(df, chunk=chunk).collect()}
    assert got == brute(ids, labels, x)


def test_unusable_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, -0.0], 0), (3, None, 0), (4, [0.0, 0.0], 0), (5, [1.0, nan], 0),
            (6, [1.0, inf], 0), (7, [1.0, None], 0), (8, [1.0, 0.0], None), (9, [], 0), (None, [1.0, 0.0], 0),
            (10, [1.0], 0), (11, [0.0, 1.0], 0), (1, [1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in S.near_vectors(df).collect())
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)]
    assert got == sorted(alone + [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (0, 0, 0, False)])


def test_empty_table(spark):
    assert S.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_every_near_pair_shares_a_cell():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 16)) * 0.05
    r = 0.1
    row, cell, home = S.cells(x, r, 4)
    at = {}
    for i, c, h in zip(row, cell, home):
        at.setdefault((int(c)), []).append((int(i), bool(h)))
    met = {}
    for members in at.values():
        for i, hi in members:
            for j, hj in members:
                if i < j and (hi or hj):
                    met[i, j] = met.get((i, j), 0) + 1
    gap = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    for i, j in zip(*np.nonzero(np.triu(gap <= r * r, 1))):
        assert met.get((int(i), int(j))) == 1
