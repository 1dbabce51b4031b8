"""V1/V2 known answers and text helpers."""

import numpy as np
from pyspark.sql import functions as F

from quire.functions.embedding import embed_many, murmur3, murmur3_many, tokens
from quire.functions.text import approx_tokens, snippet, utf16_length


def _reference_murmur(b, seed=0):
    h, n = seed, len(b)
    for i in range(n // 4):
        k = int.from_bytes(b[4 * i:4 * i + 4], "little")
        k = (k * 0xCC9E2D51) & 0xFFFFFFFF
        k = ((k << 15) | (k >> 17)) & 0xFFFFFFFF
        k = (k * 0x1B873593) & 0xFFFFFFFF
        h ^= k
        h = ((h << 13) | (h >> 19)) & 0xFFFFFFFF
        h = (h * 5 + 0xE6546B64) & 0xFFFFFFFF
    tail, k = b[4 * (n // 4):], 0
    for j in range(len(tail) - 1, -1, -1):
        k = (k << 8) | tail[j]
    if tail:
        k = (k * 0xCC9E2D51) & 0xFFFFFFFF
        k = ((k << 15) | (k >> 17)) & 0xFFFFFFFF
        k = (k * 0x1B873593) & 0xFFFFFFFF
        h ^= k
    h ^= n
    h ^= h >> 16
    h = (h * 0x85EBCA6B) & 0xFFFFFFFF
    h ^= h >> 13
    h = (h * 0xC2B2AE35) & 0xFFFFFFFF
    return h ^ (h >> 16)


def test_hash_known_answers():
    assert murmur3("") == 0
    assert murmur3("hello") == 0x248BFA47
    assert murmur3("test") == 0xBA6BD213


def test_vectorised_hash_matches_scalar():
    rng = np.random.default_rng(0)
    keys = [bytes(rng.integers(0, 256, size=int(n)).tolist()) for n in rng.integers(0, 300, size=2000)]
    got = murmur3_many(keys)
    assert all(int(g) == _reference_murmur(k) for g, k in zip(got, keys))


def test_tokens_ascii_word_split():
    assert tokens("Café's_x don't—stop") == ["caf", "'s_x", "don't", "stop"]


def test_embedding_properties():
    m = embed_many(["", "alpha beta", "alpha beta", "Alpha, BETA!"])
    assert m.dtype == np.float32 and m.shape == (4, 256)
    assert not m[0].any()  # empty text: zero vector
    assert np.allclose(np.linalg.norm(m[1]), 1.0, atol=1e-6)
    assert np.array_equal(m[1], m[2]) and np.array_equal(m[1], m[3])
    # odd bins only ever get +1, even bins -1
    nz = np.nonzero(m[1])[0]
    assert all((m[1][i] > 0) == (i % 2 == 1) for i in nz)


def test_bigram_joiner_is_a_zero_byte():
    manual = np.zeros(256)
    toks = ["alpha", "beta", "gamma"]
    for f in toks + [a + "\x00" + b for a, b in zip(toks, toks[1:])]:
        h = murmur3(f)
        manual[h % 256] += 1 if h & 1 else -1
    manual /= np.linalg.norm(manual)
    assert np.allclose(embed_many(["alpha beta gamma"])[0], manual, atol=1e-6)


def test_text_helpers(spark):
    df = spark.createDataFrame([("a😀", "", "line1\nline2"), ("x" * 10, "Desc", "b")], "t string, d string, b string")
    r = df.select(
        utf16_length(F.col("t")).alias("n"), approx_tokens(F.lit(6)).alias("k"),
        snippet(F.col("d"), F.col("b")).alias("s"),
    ).collect()
    assert r[0].n == 3 and r[0].k == 2 and r[0].s == "line1 line2"
    assert r[1].n == 10 and r[1].s == "Desc"


def test_snippet_counts_utf16_units(spark):
    rows = [("😀" * 300,), ("a" + "😀" * 300,), ("é" * 300,), ("x" * 199 + "😀",), (None,)]
    got = [r.s for r in spark.createDataFrame(rows, "b string").select(snippet(F.lit(""), F.col("b")).alias("s")).collect()]
    assert got == ["😀" * 100, "a" + "😀" * 99, "é" * 200, "x" * 199, ""]


def test_vectors_do_not_depend_on_the_pieces_and_memory_does_not_grow_with_the_batch():
    import tracemalloc

    from quire.functions.embedding import _pieces

    texts = ["a b a", None, "", "c", "a b " * 300, "it's x_1 " * 50, "d e"]
    whole = embed_many(texts)
    for most in (2, 3, 100, 601):
        assert all(len(toks) <= most for _, _, toks, _ in _pieces(texts, most))
        assert (embed_many(texts, most) == whole).all()
    assert (whole[4] == embed_many([texts[4]])[0]).all() and not whole[1].any()

    rng = np.random.default_rng(1)
    batch = [" ".join(f"w{i}" for i in rng.integers(0, 5000, size=1000)) for _ in range(3000)]
    tracemalloc.start()
    embed_many(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6  # the batch in one piece: about 1 GB


def test_a_batch_is_embedded_in_slices_and_is_never_whole_in_python():
    import tracemalloc

    import pyarrow as pa

    from quire.functions.embedding import SLICE_TEXTS, _embed_batch

    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 500, size=400)) for _ in range(8 * SLICE_TEXTS)] + [None, "", "a b"]
    batch = pa.array(texts)
    tracemalloc.start()
    got = _embed_batch(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == len(texts) and got.null_count == 0
    some = [0, SLICE_TEXTS - 1, SLICE_TEXTS, 5 * SLICE_TEXTS + 7, len(texts) - 3, len(texts) - 2, len(texts) - 1]
    assert (np.array(got.take(pa.array(some)).to_pylist(), np.float32) == embed_many([texts[i] for i in some])).all()
    # the vectors, 4 bytes an entry, and what a slice and a piece take; before, the whole batch was held three times in double precision
    assert peak < 256 * 4 * len(texts) + 25e6
    assert len(_embed_batch(batch.slice(0, 0))) == 0


def test_folding_is_the_same_for_ascii_and_other_texts(spark):
    from quire.functions.text import FOLDED_MARKS, fold, fts_tokens

    texts = ["", "Tip-TOP x1_a", "Kİ État", "Áb", "STRASSE Σς", "\x00\x7fZ", None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", fold("t").alias("f"), fts_tokens(F.col("t")).alias("k"))
    rows = {r.i: (r.f, r.k) for r in got.collect()}
    assert [rows[i][0] for i in range(7)] == ["", "tip-top x1_a", "ki etat", "ab", "strasse σσ", "\x00\x7fz", None]
    assert rows[1][1] == ["tip", "top", "x1", "a"] and rows[2][1] == ["ki", "etat"] and rows[6][1] == []
    assert not any(m.isascii() for m in FOLDED_MARKS)
