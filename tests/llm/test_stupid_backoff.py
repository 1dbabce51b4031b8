import math
import random
import re
from collections import Counter

import pytest

from quire.llm import stupid_backoff as B


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(texts, order, alpha):
    docs = [words(t) for t in texts]
    every = lambda w: Counter(tuple(w[i:i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    own = [every(w) for w in docs]
    total = sum(own, Counter())
    corpus = sum(map(len, docs))
    out = []
    for w, mine in zip(docs, own):
        rest = lambda g: total[g] - mine[g]
        score = 0.0
        for i in range(len(w)):
            cost = 0
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - n + 1:i + 1])
                if n == 1:
                    score += math.log(max(rest(g), 0.5) / max(corpus - len(w), 1)) + cost * math.log(alpha)
                elif rest(g) > 0:
                    score += math.log(rest(g) / max(rest(g[:-1]), 1)) + cost * math.log(alpha)
                    break
                cost += 1
        out.append((len(w), score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(spark, order):
    rng = random.Random(order)
    texts = [" ".join(rng.choice(["the", "Of", "é", "a", "b", "c", "D"]) for _ in range(rng.choice([0, 1, 2, 9, 40])))
             for _ in range(60)] + [None, "", "  ", "a b c", "a b c"]
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, chunk int")
    got = {r.doc_id: r for r in B.backoff_scores(df, order, chunk_bytes=600, range_entries=50).collect()}
    assert len(got) == len(texts)
    for i, (n, s) in enumerate(brute(texts, order, 0.4)):
        assert got[i].n_words == n and got[i].log_score == pytest.approx(s, abs=1e-9), i


def test_empty_table_and_null_ids(spark):
    assert B.backoff_scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = B.backoff_scores(spark.createDataFrame([(None, None), (None, "x")], "doc_id long, text string")).collect()
    assert sorted(r.n_words for r in rows) == [0, 1] and all(r.doc_id is None for r in rows)
