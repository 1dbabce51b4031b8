import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from quire.llm import bin_pack as B


def test_equal_texts_stay_together_and_slots_are_gapless(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "bé", "ccc"]) for _ in range(rng.randint(0, 200))) for _ in range(1500)]
    rows = [(i, rng.choice(texts), "x", 9) for i in range(3000)]
    rows += [(5000, None, "x", 9), (5001, "", "x", 9), (None, "q", "x", 9), (7, rows[7][1], "x", 9)]
    got = B.pack(spark.createDataFrame(rows, "doc_id long, text string, _n string, shard int"), per_packer=400).collect()
    assert Counter((r.doc_id, r.text, r._n) for r in got) == Counter(r[:3] for r in rows)
    size, slots, shard_of = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        data = (r.text or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        shard_of[data].add(r.shard)
    assert all(len(s) == 1 for s in shard_of.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(size) == set(range(16)) and max(size.values()) < 1.05 * min(size.values())


def test_a_group_of_a_third_of_all_rows_is_cut_and_sizes_stay_near_equal(spark):
    rng = random.Random(2)
    rows = [(i, "hot text of many copies " * 5) for i in range(2000)]
    rows += [(10_000 + i, f"{i} " + "z" * rng.randint(1, 400)) for i in range(4000)]
    got = B.pack(spark.createDataFrame(rows, "doc_id long, text string"), per_packer=1000).collect()
    size, count = Counter(), Counter()
    for r in got:
        size[r.shard] += r.size
        count[r.shard] += 1
    assert len(got) == 6000 and max(size.values()) < 1.1 * min(size.values())


def test_places_where_the_residual_dot_product_is_highest():
    room = np.array([[1.0, 0.2, 1.0], [0.6, 1.0, 1.0]])
    assert list(B.place(np.array([[0.1, 0.1, 0.0], [0.5, 0.1, 0.0]]), room)) == [1, 0]


def test_empty_table(spark):
    assert B.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    (r,) = B.pack(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()
    assert (r.size, r.text_crc32, r.slot) == (1, 0, 0)


def test_null_and_equal_ids_of_a_heavy_group_are_dealt_evenly(spark):
    rng = random.Random(3)
    rows = [(None if i % 2 else 7, "hot text of many copies " * 5) for i in range(2000)]
    rows += [(i, f"{i} " + "z" * rng.randint(1, 400)) for i in range(4000)]
    rows += [(None, "x" * 3_000_000)]  # a text longer than all the rest of a shard
    got = B.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), per_packer=1000).collect()
    assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((i, zlib.crc32(t.encode())) for i, t in rows)
    size, slots = Counter(), defaultdict(list)
    for r in got:
        size[r.shard] += r.size if r.size < 10**6 else 0
        slots[r.shard].append(r.slot)
    lone = {r.shard for r in got if r.size > 10**6}
    rest = [v for k, v in size.items() if k not in lone]
    assert len(got) == 6001 and max(rest) < 1.05 * min(rest)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
