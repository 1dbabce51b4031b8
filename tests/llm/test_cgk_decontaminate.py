import random
import re

import numpy as np
import pytest

from support import SF0001
from quire.llm import cgk_decontaminate as C


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def sellers(item, text):
    """Fewest edits of item against any consecutive words of text."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (w != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def edit(rng, w, n, vocabulary):
    w = list(w)
    for _ in range(n):
        at = rng.randrange(len(w))
        kind = rng.randrange(3)
        if kind == 0:
            w[at] = rng.choice(vocabulary)
        elif kind == 1:
            del w[at]
        else:
            w.insert(at, rng.choice(vocabulary))
    return w


def test_span_of_fewest_edits_equals_the_plain_table():
    rng = random.Random(1)
    for _ in range(200):
        item, text = [rng.randrange(4) for _ in range(rng.randint(1, 7))], [rng.randrange(4) for _ in range(rng.randint(0, 12))]
        cost, a, b = C.best_span(np.array(item, np.uint64), np.array(text, np.uint64))
        assert cost == sellers(item, text)
        assert 0 <= a <= b <= len(text)


@pytest.mark.parametrize("share,least", [(0.0, 1.0), (0.1, 0.99), (0.2, 0.95)])
def test_recall_at_the_permitted_edits(share, least):
    rng = random.Random(7)
    vocabulary = [f"v{i}" for i in range(3000)] + ["the", "of", "and"] * 500
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(8, 60))] for _ in range(150)]
    index = C.build_index([(i, " ".join(w)) for i, w in enumerate(items)])
    hit = seen = 0
    for i, item in enumerate(items):
        for _ in range(1):
            w = edit(rng, item, int(share * len(item)), vocabulary)
            text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))] + w + [rng.choice(vocabulary) for _ in range(30)]
            if sellers(item, text) <= C.edits(len(item), 0.8):
                seen += 1
                found = C.word_hashes(" ".join(text).encode(), C.ALNUM)[2]
                got = C.search(np.zeros(len(found), np.int64), found, index)
                hit += any(index.ids[g[1]] == i for g in got)
    assert hit >= least * seen, (hit, seen)


@pytest.mark.parametrize("n", [65, 250, 500, 1000])
def test_recall_of_long_items_at_the_permitted_edits(n):
    rng = random.Random(n)
    vocabulary = [f"v{i}" for i in range(3000)] + ["the", "of", "and"] * 500
    items = [[rng.choice(vocabulary) for _ in range(n)] for _ in range(20)]
    index = C.build_index([(i, " ".join(w)) for i, w in enumerate(items)])
    hit = 0
    for i, item in enumerate(items):
        w = edit(rng, item, C.edits(n, 0.8), vocabulary)
        text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))] + w + [rng.choice(vocabulary) for _ in range(30)]
        found = C.word_hashes(" ".join(text).encode(), C.ALNUM)[2]
        got = [g for g in C.search(np.zeros(len(found), np.int64), found, index) if index.ids[g[1]] == i]
        # the span of fewest edits, wherever in the item the pieces were found
        hit += bool(got) and min(g[2] for g in got) == C.best_span(index.words[i], found)[0]
    assert hit >= 0.95 * len(items), hit


def test_leaks_equal_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").where("n_chars < 1500")
    benchmark = spark.read.parquet(f"{SF0001}/benchmark.parquet")
    items = [(r.item_id, words(r.text)) for r in benchmark.collect()]
    want = set()
    for d in docs.collect():
        text = words(d.text)
        known = set(zip(text, text[1:]))
        for i, w in items:
            k = C.edits(len(w), 0.8)
            # k edits destroy at most 2k of an item's pairs: the plain table is needed only for the rest
            if sum(p in known for p in zip(w, w[1:])) >= len(w) - 1 - 2 * k and sellers(w, text) <= k and len(w) >= 5:
                want.add((d.doc_id, i))
    got = {(r.doc_id, r.item_id) for r in C.find_leaks(docs, benchmark).collect()}
    assert got == want and want


def test_blocks_repeats_nulls_and_clashing_columns(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, "x " * 50 + item + " y"), (1, "x " * 50 + item + " y"), (2, "One, TWO three; four five\nsix seven eight nine!"),
            (3, None), (4, ""), (None, item), (5, "one two three"), (6, "z " * 300_000 + item)]
    df = spark.createDataFrame([(d, t, 7, "x") for d, t in docs], "doc_id long, text string, item_id int, block string")
    bench = [(10, item), (11, None), (12, ""), (13, "a b"), (10, item), (None, "p q r s t u v w")]
    bm = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.edits, r.first_word) for r in C.find_leaks(df, bm, block_items=1).collect()}
    assert got == {(1, 10, 0, 50), (2, 10, 1, 0), (None, 10, 0, 0), (6, 10, 0, 300_000)}
    none = spark.createDataFrame([], "item_id long, text string")
    assert C.find_leaks(df, none).collect() == []
    assert C.find_leaks(spark.createDataFrame([], "doc_id long, text string"), bm).collect() == []


def test_short_items_and_scripts_without_spaces(spark):
    long_cn = "\u4e2d\u56fd\u7684\u9996\u90fd\u662f\u54ea\u91cc\uff1f\u662f\u5317\u4eac\uff0c\u4e0d\u662f\u4e0a\u6d77\u3002"
    docs = [(1, "x the Answer, is y the answer is"), (2, "the answers is"), (3, "q" + long_cn + "z"),
            (4, "\u4ed6\u8bf4" + long_cn.replace("\u54ea\u91cc", "\u54ea\u513f").replace("\uff0c", "") + "\u597d\u7684"),
            (5, "\u0e01\u0e23\u0e38\u0e07\u0e40\u0e17\u0e1e\u0e2f"), (6, "the answer"), (7, "is the"), (8, "answer")]
    bench = [(10, "The answer is"), (11, long_cn), (12, "\u0e01\u0e23\u0e38\u0e07\u0e40\u0e17\u0e1e"), (13, "?!"), (14, "\u5317\u4eac")]
    got = C.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.edits, r.first_word, r.n_words, r.n_spans) for r in got.collect()} == {
        (1, 10, 0, 1, 3, 2), (3, 11, 0, 1, 15, 1), (4, 11, 1, 2, 15, 1), (5, 12, 0, 0, 7, 1), (3, 14, 0, 10, 2, 1), (4, 14, 0, 11, 2, 1)}
