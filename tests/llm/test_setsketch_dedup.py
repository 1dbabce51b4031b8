import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import setsketch_dedup as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def sets_of(texts, width):
    out = []
    for t in texts:
        w = WORD.findall(lower(t))
        out.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width
                   else ({tuple(w)} if w else set()))
    return out


def brute(rows, width, percent):
    sets = sets_of([t for _, t in rows], width)
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[root(i)] = min(best.get(root(i), d), d)
    return {(d, len(sets[i]), best[root(i)], best[root(i)] == d) for i, (d, _) in enumerate(rows)}


def copies(n, seed=1):
    """Originals, exact copies and copies with a few words changed; short and empty texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["über", "Zé", "A"]
    rows, texts = [], []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.5:
            w = rng.choice(texts).split(" ")
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 5, 60, 90]))]
        texts.append(" ".join(w))
        rows.append((1000 - i, texts[-1]))
    return rows


def test_words_and_shingles_of_any_text():
    texts = ["", " ", "a", "A b", "a b c d", "x\x0by\tz q r w", "é É e", "a b c a b c"]
    got = [len(s) for s in S.shingle_sets([t.encode().lower() for t in texts], 3)]
    assert got == [len(s) for s in sets_of(texts, 3)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \té x", max_size=30), min_size=1, max_size=8))
def test_equal_sets_have_equal_hashes(texts):
    got = list(S.shingle_sets([t.encode().lower() for t in texts], 3))
    want = sets_of(texts, 3)
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


def test_very_long_text_equals_its_slices():
    rng = random.Random(3)
    words = [str(rng.randrange(10**9)) for _ in range(300_000)]
    text = " ".join(words).encode()
    (got,) = S.shingle_sets([text], 3)
    assert len(got) == len(words) - 2
    part = next(S.shingle_sets([" ".join(words[150_000:150_100]).encode()], 3))
    assert np.isin(part, got).all()


def test_registers_are_mergeable_and_estimate_similarity():
    rng = np.random.default_rng(5)
    pool = rng.integers(1, 1 << 62, 6000, dtype=np.uint64)
    a, b = pool[:4000], pool[1000:5000]
    ra, rb = S.registers(a, 1024), S.registers(b, 1024)
    assert (np.maximum(ra, rb) == S.registers(pool[:5000], 1024)).all()
    guess = S.joint_similarity(np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]), 1024,
                               np.array([4000.0]), np.array([4000.0]))
    assert abs(guess[0] - 3000 / 5000) < 0.06


def test_classes_equal_brute_force(spark):
    rows = copies(260)
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, rows[5][1].upper())]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, rep string, component int")
    for width, percent in ((3, 85), (5, 80)):
        got = {tuple(r) for r in S.near_duplicates(df, width, percent).collect()}
        want = {(d, n, c, k) if n else (d, 0, d, True) for d, n, c, k in brute(rows, width, percent)}
        assert got == want


def test_chunked_classes_equal_brute_force(spark):
    base = " ".join(f"t{i}" for i in range(80))
    rng = random.Random(2)
    rows = []
    for i in range(120):
        w = base.split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(80)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in S.near_duplicates(df, 3, 85, chunk_docs=16).collect()}
    assert got == brute(rows, 3, 85)


def test_empty_table_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(df).collect() == []
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "q r s t u"), (9, "a b c d e f")]
    got = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [
        (-1, -1, False), (-1, 4, False), (4, 4, True), (4, 4, True), (9, 4, False)]
