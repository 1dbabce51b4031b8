import bisect
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from quire.llm import token_alignment as T
from quire.llm.tokens import byte_letters, json_tokenizer, piece_tokenizer

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def whole(text):
    """(A ids, their bytes, B ids, their bytes) of a text encoded as a whole, or None."""
    ta, tb, letter = json_tokenizer(A, plain=True), piece_tokenizer(B), byte_letters()
    a, b = ta.encode(" " + text, add_special_tokens=False).ids, tb.encode(text)
    xa = [bytes(letter[c] for c in ta.id_to_token(i)) for i in a]
    xb = [bytes([int(tb.id_to_piece(i)[3:5], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(xa) != (" " + text).encode() or b"".join(xb) != (" " + text).encode():
        return None
    return a, xa, b, xb


def brute(texts):
    """Rows (n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) by definition."""
    found = []
    for t in texts:
        one = whole(t) if t else None
        if one is None:
            found.append(None)
            continue
        a, xa, b, xb = one
        ea, eb = np.cumsum([len(x) for x in xa]).tolist(), np.cumsum([len(x) for x in xb]).tolist()
        cuts = sorted(set(ea) & set(eb))
        groups = [([], []) for _ in cuts]
        for ids, ends, side in ((a, ea, 0), (b, eb, 1)):
            for i, e in zip(ids, ends):
                groups[bisect.bisect_left(cuts, e)][side].append(i)
        found.append((len(a), len(b), groups))
    count = Counter()
    for f in found:
        if f:
            count.update({(i, j) for x, y in f[2] for i in x for j in y})
    most = defaultdict(int)
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(i, j) for x, y in f[2] for i in x for j in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in f[2])
        out.append((f[0], f[1], len(f[2]), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest()))
    return out


BITS = ["hello", "Straße", "naïve", "東京都", "🙂🙂", "x1y2z3", "<|endoftext|>", "<s>", "</s>", "don't", "--", "\x1c", "\x00", "é", "é",
        " ", "     ", "\t", " ", "　", "हिन्दी", "עברית", "12345", "ab" * 30, "_", "ﬁ", " ", "​", "<0x41>"]
GAPS = [" ", "  ", "\n", " \n ", "", "\r\n", " \t"]


def texts(seed, n):
    rng = random.Random(seed)
    out = ["".join(rng.choice(BITS) + rng.choice(GAPS) for _ in range(rng.randint(1, 40))) for _ in range(n)]
    return out + [None, "", " ", "  ", "a ", "a  ", " a", "▁", "x ▁y", "\n", "same text", "same text", "no" * 3000, "日本語" * 500]


@pytest.mark.parametrize("chunk", [1 << 9, 32 << 20])
def test_equals_brute_force(spark, chunk):
    all_texts = texts(chunk, 60)
    ids = [2**53 + 1 + i for i in range(len(all_texts) - 2)] + [None, 2**63 - 1]
    df = spark.createDataFrame([(i, t, 5, b"z") for i, t in zip(ids, all_texts)], "doc_id long, text string, n_a int, pairs binary")
    got = sorted(((r[0] or 0), *r[1:]) for r in T.align(df.repartition(3), chunk=chunk).collect())
    assert got == sorted((i or 0, *row) for i, row in zip(ids, brute(all_texts)))


@pytest.mark.parametrize("most", [1 << 20, 20])
def test_ranks_and_slices_change_no_id(most):
    pair = T.Pair(A, B, most)
    assert pair.ranked is not None and pair.cut is not None
    every = ["".join(f"a{chr(c)}b {chr(c)} 1{chr(c)}'s" for c in range(at, at + 128) if not 0xD800 <= c < 0xE000) for at in range(1, 0x11000, 128)]
    for t in texts(5, 400) + every:
        one = whole(t) if t else None
        a, b = pair.ids(t.encode() if t else None)
        want = (one[0], one[2]) if one else ([], [])
        assert (np.frombuffer(a, pair.a.kind).tolist(), np.frombuffer(b, pair.b.kind).tolist()) == want, t


def test_gallop_finds_common_entries():
    rng = random.Random(2)
    for _ in range(200):
        docs, base = [], 0
        for _ in range(rng.randint(1, 5)):
            size = rng.randint(1, 90)
            long = sorted(rng.sample(range(1, 200), size)) + [200]
            short = sorted(rng.sample(range(1, 200), rng.randint(0, size))) + [200]
            docs.append(([base + v for v in short], [base + v for v in long]))
            base += 200
        short, long = np.concatenate([s for s, _ in docs]), np.concatenate([x for _, x in docs])
        first = np.cumsum([0] + [len(s) for s, _ in docs[:-1]])
        start = np.cumsum([0] + [len(x) for _, x in docs[:-1]])
        i, j = T.common_ends(short, long, first, start)
        assert short[i].tolist() == sorted(set(short.tolist()) & set(long.tolist())) == long[j].tolist()


def test_links_of_a_wide_group_are_expanded_in_parts(monkeypatch):
    pair = T.pair_of(A, B)
    batch = T.Batch(pair, [pair.ids(t.encode()) for t in ("日本語" * 200, "plain words", "🙂" * 300, "x" * 50)])
    want = [(d, k.tolist(), c.tolist()) for d, k, c in batch.pairs()]
    monkeypatch.setattr(T, "_LINKS", 7)
    assert [(d, k.tolist(), c.tolist()) for d, k, c in batch.pairs()] == want
    assert [sum(c) for _, _, c in want] == batch.n_links.tolist()


def test_squeezed_pairs_come_back():
    rng = np.random.default_rng(0)
    for keys, counts in (([], []), ([5], [1]), (rng.integers(0, 1 << 40, 100), rng.integers(1, 9, 100)),
                         (rng.integers(0, 1 << 31, 1000), rng.integers(1, 1 << 20, 1000))):
        keys, counts = np.sort(np.array(keys, np.int64)), np.array(counts, np.int64)
        k, c = T.unsqueeze(T.squeeze(keys, counts))
        assert k.tolist() == keys.tolist() and c.tolist() == counts.tolist()


def test_groups_give_byte_ends_and_ids(spark):
    df = spark.createDataFrame([(1, "naïve Straße 🙂"), (None, None), (3, "")], "doc_id long, text string")
    got = sorted(T.groups(df).collect(), key=lambda r: r.position)
    a, xa, b, xb = whole("naïve Straße 🙂")
    assert [i for r in got for i in r.a_ids] == a and [i for r in got for i in r.b_ids] == b
    assert [r.end for r in got] == sorted(set(np.cumsum([len(x) for x in xa]).tolist()) & set(np.cumsum([len(x) for x in xb]).tolist()))
    assert {r.doc_id for r in got} == {1}


def test_bytes_that_are_no_text_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, bytearray(b"ok \xff\xfe")), (2, bytearray(b"ok"))], "doc_id long, b binary")
    got = {r.doc_id: r for r in T.align(df.selectExpr("doc_id", "cast(b as string) as text")).collect()}
    assert got[1].n_a == 0 and got[1].groups_sha256 == "" and got[2].n_a == 1
    assert T.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []
