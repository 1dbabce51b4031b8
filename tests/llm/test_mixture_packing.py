import random
import zlib

import numpy as np
import pytest

from quire.llm import mixture_packing as M
from quire.llm.tokens import json_tokenizer

TOKENIZER = "word_bpe_49k.json"


def whole_ids(text):
    t = json_tokenizer(TOKENIZER, plain=False)
    return t.encode(text or "", add_special_tokens=False).ids + [2]


def round_robin(totals, weights, window, grain):
    """(queue, token) in stream order, by serving rounds one after the other."""
    left, earned, taken, out = list(totals), [0] * len(totals), [0] * len(totals), []
    while any(left):
        for q, w in enumerate(weights):
            earned[q] += window * w  # in units of 1 / sum(weights) token
        for q in range(len(totals)):
            units = earned[q] // (sum(weights) * grain)
            earned[q] -= units * sum(weights) * grain
            serve = min(units * grain, left[q])
            out += [(q, taken[q] + i) for i in range(serve)]
            taken[q] += serve
            left[q] -= serve
    return out


@pytest.mark.parametrize("seed", range(6))
def test_closed_form_equals_serving_round_by_round(seed):
    rng = random.Random(seed)
    k, window, grain = rng.randint(1, 6), rng.choice([8, 16, 30]), rng.choice([1, 3, 4])
    totals = [rng.choice([0, rng.randint(1, 400)]) for _ in range(k)] + [rng.randint(1, 60)]
    weights = [max(1, t) for t in totals] if seed % 2 else [rng.randint(1, 9) for _ in totals]
    plan = M.Schedule(totals, weights, window, grain)
    place = {token: g for g, token in enumerate(round_robin(totals, weights, window, grain))}
    bounds = plan.tail.tolist()
    starts = list(range(0, plan.full * window, window)) + bounds[:-1]
    for q, total in enumerate(totals):
        at = 0
        while at < total:
            size = min(rng.randint(1, 70), total - at)
            doc, start, length, seq, off = M.Schedule.pieces(plan, np.array([q]), np.array([at]), np.array([size]))
            got = [(at + s + i, starts[x] + o + i) for s, n, x, o in zip(start, length, seq, off) for i in range(n)]
            assert got == [(t, place[q, t]) for t in range(at, at + size)]
            at += size
    assert bounds[-1] == sum(totals) and all((b - a) & (b - a - 1) == 0 for a, b in zip(bounds, bounds[1:]))


def test_products_beyond_64_bits_are_exact():
    rng = random.Random(3)
    a = [rng.randint(0, 1 << 45) for _ in range(500)]
    b = [rng.randint(1, 1 << 45) for _ in range(500)]
    c = [max(x * y >> 49, 1) + rng.randint(1, 1 << 40) for x, y in zip(a, b)]
    q, r = M.muldiv(np.array(a), np.array(b), np.array(c))
    assert [(int(x), int(y)) for x, y in zip(q, r)] == [divmod(x * y, z) for x, y, z in zip(a, b, c)]


def checked(rows, pieces, window, tokenizer=whole_ids):
    """The laws of a packing; returns the pieces by sequence."""
    want = sorted(tuple(tokenizer(t)) for _, t, _ in rows)
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault((p.doc_id, p.source), []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    got = []
    for own in by_doc.values():
        own.sort(key=lambda p: p.start)
        ids = np.concatenate([np.frombuffer(p.ids, "<u4") for p in own])
        assert [p.start for p in own] == np.concatenate([[0], np.cumsum([p.length for p in own])[:-1]]).tolist()
        assert all(p.doc_tokens == len(ids) and zlib.crc32(p.ids) == p.ids_crc32 for p in own)
        got.append(tuple(ids.tolist()))
    assert sorted(got) == want
    assert sorted(by_seq) == list(range(len(by_seq)))
    short = []
    for _, own in sorted(by_seq.items()):
        own.sort(key=lambda p: p.offset)
        at = 0
        for p in own:
            assert p.offset == at
            at += p.length
        assert at == window or at & (at - 1) == 0
        short += [at] if at != window else []
    assert sorted(set(short), reverse=True) == short
    return by_seq


WORDS = ["alpha", "Beta's", "ΣΑΣ", "naïve", "東京", "x1y2", "<|endoftext|>", "é", "--", "the", "\x1c", "don't", " ", "a b", "🙂"]


def corpus(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = "".join(rng.choice(WORDS) + rng.choice([" ", "  ", "\n", " \n ", "\t", "", "\r\n"]) for _ in range(rng.randint(0, 60)))
        rows.append((2**53 + 1 + i, text, rng.choice(["a", "a", "a", "b", None, "", f"tiny{i}"])))
    return rows + [(1, None, "b"), (2, "", None), (2**63 - 1, "long " * 4000, "a"), (3, "x" * 5000, "b")]


@pytest.mark.parametrize("targets", [None, {"a": 1.0, None: 3.0}, {}])
def test_pieces_hold_every_id_once(spark, targets):
    rows = corpus(1, 60)
    df = spark.createDataFrame([(*r, 9, b"x") for r in rows], "doc_id long, text string, source string, start long, ids binary").repartition(4)
    got = M.pack(df, window=256, grain=8, targets=targets).collect()
    checked(rows, got, 256)


def test_windows_keep_the_sources_shares(spark):
    rows = [(i, "word " * (50 + i % 90), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(900)]
    pieces = M.pack(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6), window=1024, grain=16).collect()
    windows = checked(rows, pieces, 1024)
    total = {}
    for p in pieces:
        total[p.source] = total.get(p.source, 0) + p.length
    n = sum(total.values())
    for seq in range(n // 1024 - 1):  # the very last window takes what the others left
        for source, t in total.items():
            own = sum(p.length for p in windows[seq] if p.source == source)
            assert abs(own - 1024 * t / n) <= 4 * 16


def test_null_and_repeated_ids(spark):
    rows = [(None, "one two", "a"), (7, "same text", "a"), (7, "same text", "a"), (7, "same text", None)]
    got = M.pack(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sum(p.length for p in got) == sum(len(whole_ids(t)) for _, t, _ in rows)
    assert sorted((p.doc_id or 0, p.start, p.doc_tokens) for p in got if p.start == 0) == [(0, 0, 3), (7, 0, 3), (7, 0, 3), (7, 0, 3)]


def test_empty_table(spark):
    assert M.pack(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_whole_table(spark):
    out = M.op12_mixture_packing(spark, "/root/testdata/sf0.001").toPandas()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for doc_id, own in out.groupby("doc_id"):
        ids = np.array(whole_ids(docs[doc_id]), "<u4")
        own = own.sort_values("start")
        assert own["length"].sum() == len(ids) and (own["doc_tokens"] == len(ids)).all()
        for start, length, crc in zip(own["start"], own["length"], own["ids_crc32"]):
            assert zlib.crc32(ids[start : start + length].tobytes()) == crc
    size = out.groupby("sequence_id")["length"].sum().to_numpy()
    assert ((size == 4096) | (size & (size - 1) == 0)).all() and (size == 4096).sum() == size.sum() // 4096


def test_every_character_and_special_string_as_the_file_reads_it():
    words = M._encoder(TOKENIZER)
    whole = json_tokenizer(TOKENIZER, plain=False)
    assert words.ranked is not None
    for at in range(1, 0x11000, 256):
        text = "".join(f"a{chr(c)}B {chr(c)} 1{chr(c)}'s{chr(c)}{chr(c)} " for c in range(at, at + 256) if not 0xD800 <= c < 0xE000)
        assert np.concatenate(words.of(text)).tolist() == whole.encode(text, add_special_tokens=False).ids, at
    for text in ("x<|endoftext|>y <|startoftext|> <|ENDOFTEXT|>", "ΟΔΟΣ Σ ΣΑ", "I\u0307 \u0130", "a\x00b \x00 c", "e\u0301 \u1100\u1161", ""):
        assert [i for p in words.of(text) for i in p.tolist()] == whole.encode(text, add_special_tokens=False).ids


def test_slices_of_a_long_text_change_nothing():
    words = M.WordIds(TOKENIZER, most=50)
    text = " ".join(random.Random(4).choice(WORDS) for _ in range(900)) + "\n\n tail"
    assert np.concatenate(words.of(text)).tolist() == whole_ids(text)[:-1]
