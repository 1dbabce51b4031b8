import random
from collections import Counter

import pytest

from quire.llm import source_mix as M


def water_fill(sizes, cap=3):
    """Iterative definition: share by weight, stop at the cap, share the excess anew."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        above = [s for s in free if share[s] > cap * sizes[s]]
        if not above:
            return capped | share
        capped |= {s: cap * sizes[s] for s in above}


def rows_of(seed, n):
    rng = random.Random(seed)
    names = ["a", "B", "é", "zz", "😀", "hot", None, ""]
    return [(i, " ".join(["w"] * rng.choice([0, 1, 30, 200, 900])),
             "hot" if rng.random() < 0.4 else rng.choice(names), 5) for i in range(n)]


def test_targets_equal_the_iterative_definition(spark):
    for seed in range(4):
        rng = random.Random(seed)
        sizes = {s: rng.choice([0, 1, 10, 100, 1000, 5000]) for s in ["a", "b", "c", "D", "é", "zz", None]}
        sizes["big"] = 20_000
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in M.targets(df).collect()}
        want = water_fill(sizes)
        assert got.keys() == want.keys()
        for s in want:
            assert got[s] == pytest.approx(want[s]), s


def test_permutation_covers_every_index_once(spark):
    df = spark.range(1000).selectExpr("id % 7 as k", "id div 7 as x").where("x < 140").selectExpr("k", "x", "140L as n")
    got = M.permute(df, "x", "n", ["k"], 3, "y").collect()
    by = {}
    for r in got:
        by.setdefault(r.k, {})[r.x] = r.y
    assert all(sorted(m.values()) == sorted(m) == list(range(140)) for m in by.values())
    assert len({tuple(m[i] for i in range(140)) for m in by.values()}) == 7
    one = spark.range(1).selectExpr("0 as k", "id as x", "1L as n")
    assert M.permute(one, "x", "n", ["k"], 3, "y").first().y == 0


def test_taken_words_meet_targets_and_caps(spark):
    rows = rows_of(1, 1500)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    mix = M.Mix(df, block=16, shard_blocks=64)
    got = mix.taken().collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    taken, target, size = Counter(), {}, Counter()
    words = {r[0]: len(r[1].split()) for r in rows}
    for r in got:
        assert r.size == words[r.doc_id] and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        size[r.source] += r.size
        target[r.source] = r.target
    want = water_fill(size)
    for s in target:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 32, s
    assert {tuple(r) for r in mix.taken().collect()} == {tuple(r) for r in got}
    slots = mix.slots.collect()
    assert sorted(r.slot for r in slots) == list(range(len(slots)))
    assert max(Counter((r.src, r.block) for r in slots).values()) <= 3
    draws = {(r.shard, r.src): r.draws for r in mix.draws().collect()}
    assert len({n for (_, s), n in draws.items() if s == 4}) > 1  # counts vary over shards
    # Taken words are the pieces of the slots' blocks.
    held = mix.pieces().join(mix.slots, ["src", "block"]).groupBy("src").sum("words").collect()
    assert sum(r[1] for r in held) == sum(taken.values())


def test_documents_of_the_mix(spark):
    rows = rows_of(2, 800)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken int")
    out = M.mix_documents(df)
    assert out.columns == df.columns
    copies = Counter(r.doc_id for r in out.collect())
    assert max(copies.values()) <= 3 and set(copies) <= {r[0] for r in rows if r[1]}


def test_nulls_repeats_and_empty_tables(spark):
    schema = "doc_id long, text string, source string"
    assert M.Mix(spark.createDataFrame([], schema)).taken().collect() == []
    rows = [(1, None, None), (1, "", None), (None, " \t", "a")]
    assert sorted(r.taken for r in M.Mix(spark.createDataFrame(rows, schema)).taken().collect()) == [0, 0, 0]
    rows = [(1, "a b c", None)] * 3 + [(None, "x y", "s")]
    got = M.Mix(spark.createDataFrame(rows, schema), block=2).taken().collect()
    assert len(got) == 4 and all(r.taken <= 3 * r.size for r in got)
