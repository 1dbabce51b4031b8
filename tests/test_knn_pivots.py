"""Search by pivots equals the broadcast search and brute force, and prunes clustered vectors."""

import numpy as np
import pytest

from quire.operators import vector


def clustered(n, d, seed, spread):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((8, d)) * 3
    return centre[rng.integers(0, 8, n)] + rng.standard_normal((n, d)) * spread


def brute(x, q, ids, keys, ks, allowed=None, types=None):
    out = set()
    unit = lambda v: v / np.sqrt((v * v).sum(axis=1))[:, None]
    d = 1 - unit(q) @ unit(x).T
    for i, k in enumerate(ks):
        rows = [j for j in range(len(x)) if allowed is None or not allowed[i] or types[j] in allowed[i]]
        rows.sort(key=lambda j: (round(d[i, j], 12), keys[j]))
        out |= {(i, ids[j], p) for p, j in enumerate(rows[:k], 1)}
    return out


@pytest.mark.parametrize("partitioned", [True, False])
@pytest.mark.parametrize("spread", [0.05, 2.0])
def test_equals_brute_force(spark, partitioned, spread):
    x = clustered(500, 12, 1, spread).astype(np.float32).astype(float)
    x[50:60] = x[49]  # ties at the cut
    q = np.vstack([clustered(60, 12, 1, spread)[:30], x[40:55]]).astype(np.float32).astype(float)
    types = [("a", "b", "c")[i % 3] for i in range(500)]
    allowed = [[] if i % 2 else ["a", "c"] for i in range(len(q))]
    ks = [1 + i % 12 for i in range(len(q))]
    ids, keys = [2**53 + 1 + i for i in range(500)], [f"s{(i * 7) % 500:03d}" for i in range(500)]
    rows = [(i, k, v.tolist(), t) for i, k, v, t in zip(ids, keys, x, types)] + [(7, "zero", [0.0] * 12, "a")]
    corpus = spark.createDataFrame(rows, "id long, slug string, embedding array<float>, type string").repartition(3)
    asks = spark.createDataFrame([(i, v.tolist(), k, a) for i, (v, k, a) in enumerate(zip(q, ks, allowed))]
                                 + [(900, [0.0] * 12, 3, []), (901, None, 3, [])], "query_id long, qvec array<float>, k int, types array<string>")
    got = vector.knn(corpus, asks, types_col="types", partitioned=partitioned, cell_rows=20, max_cells=16).collect()
    assert {(r.query_id, r.id, r.vec_pos) for r in got} == brute(x, q, ids, keys, ks, allowed, types)
    plain = vector.knn(corpus, asks.drop("types"), partitioned=partitioned, cell_rows=20, max_cells=16).collect()
    assert {(r.query_id, r.id, r.vec_pos) for r in plain} == brute(x, q, ids, keys, ks)


def test_bounds_prune_clustered_vectors():
    x = clustered(2000, 16, 3, 0.05)
    unit, _ = vector._units(x)
    pivots = unit[:32]
    gap = vector._gaps(unit, pivots)
    cell, own = gap.argmin(axis=1), gap.min(axis=1)
    radius = np.array([own[cell == c].max(initial=-np.inf) for c in range(32)])
    d = np.sort(1 - unit @ unit.T, axis=1)[:, 9]
    met = vector.reachable(gap, radius, np.sqrt(2 * d))
    assert (met * np.bincount(cell, minlength=32)).sum() < 0.3 * len(x) ** 2
    near = (1 - unit @ unit.T) <= d[:, None]
    assert all(met[i, cell[j]] for i, j in zip(*np.nonzero(near)))  # no neighbour's cell is left out


def test_empty_tables(spark):
    corpus = spark.createDataFrame([], "id long, slug string, embedding array<float>")
    asks = spark.createDataFrame([(1, [1.0, 0.0], 2)], "query_id long, qvec array<float>, k int")
    for way in (True, False):
        assert vector.knn(corpus, asks, partitioned=way).collect() == []
        assert vector.knn(spark.createDataFrame([(1, "a", [1.0, 0.0])], corpus.schema), asks.limit(0), partitioned=way).collect() == []


def test_a_query_keeps_few_candidates_however_many_cells_it_meets(spark):
    x = np.random.default_rng(4).standard_normal((600, 32)).astype(np.float32).astype(float)
    body = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(x)], "id long, _key long, embedding array<float>")
    asks = body.selectExpr("id as query_id", "embedding as qvec", "5 as k")
    found = vector._by_pivots(body, asks, body.schema["_key"].dataType, 20, 1024, False).groupBy("query_id").count().collect()
    assert len(found) == 600
    assert sum(r["count"] for r in found) < 600 * 5 * 6  # five of every one of the 30 cells before


@pytest.mark.parametrize("bound", [np.inf, 0.4])
def test_nearest_equals_brute_force(bound):
    rng = np.random.default_rng(5)
    x, _ = vector._units(rng.standard_normal((9000, 8)))
    x[5000:5020] = x[10]
    q, ks = x[:40], 1 + np.arange(40) % 15
    row, query, far = vector._nearest(x, q, ks, np.full(40, bound))
    d = 1 - q @ x.T
    for i, k in enumerate(ks):
        cut = min(np.partition(d[i], k - 1)[k - 1], bound)
        mine = row[query == i]
        assert set(np.flatnonzero(d[i] <= cut - 1e-13)) <= set(mine) and (d[i, mine] <= cut + 2e-12).all()
        assert np.abs(far[query == i] - d[i, mine]).max() < 1e-14
    assert set(range(5000, 5020)) <= set(row[query == 10])


def test_a_scan_takes_bounded_blocks_of_rows_and_queries_and_keeps_the_nearest():
    import tracemalloc
    from types import SimpleNamespace

    import pandas as pd

    rng = np.random.default_rng(6)
    x = rng.standard_normal((12_000, 8)).astype(np.float32)
    x[7000:7020] = x[10]
    x[3] = 0
    q = x[[10, *range(100, 800)]].astype(float)
    ks = 1 + np.arange(len(q)) % 15
    asked = {"vecs": q, "norms": np.sqrt((q * q).sum(axis=1)), "ids": np.arange(len(q)), "k": ks, "types": None}
    pdf = pd.DataFrame({"id": np.arange(len(x)), "_key": np.arange(len(x)), "embedding": list(x)})
    tracemalloc.start()
    got = pd.concat(vector._partition_topk(SimpleNamespace(value=asked))(iter([pdf[:10_000], pdf[:0], pdf[10_000:]])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70e6  # a whole batch at a time: about 130 MB
    d = 1 - (q / asked["norms"][:, None]) @ (x / np.maximum(np.linalg.norm(x.astype(float), axis=1), 1e-30)[:, None]).T
    d[:, 3] = np.inf
    cut = np.array([np.partition(d[i], k - 1)[k - 1] for i, k in enumerate(ks)])
    mine = set(zip(got["query_id"], got["id"]))
    assert {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= cut[:, None] - 1e-12))} <= mine
    assert (d[got["query_id"], got["id"]] <= cut[got["query_id"]] + 2e-12).all()
    assert {(0, j) for j in range(7000, 7020)} <= mine
