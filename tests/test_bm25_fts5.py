"""BM25 ranking against SQLite FTS5 (the engine the reference ranks with)."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from quire.operators import fts, hybrid

DOCS = [
    (1, "Alpha guide", "About alpha", ["x", "y"], "alpha beta gamma. alpha again, beta-gamma here"),
    (2, "Beta notes", "", ["y"], "beta beta beta and delta"),
    (3, "Gamma", "gamma ray", [], "Nothing about the others, café crème"),
    (4, "Delta", "cafe", ["x"], "delta delta alpha beta gamma delta"),
    (5, "", "", [], "the the the the the and the"),
    (6, "alpha", "", [], "zeta only words here"),
]
QUERIES = ["alpha", "beta gamma", "beta-gamma", "café", "the", "alpha alpha", "zeta \"delta\"", "ray-gun"]


def _fts5_ranks(query):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(title, description, tags, body, tokenize='unicode61')")
    for i, ti, de, tg, bo in DOCS:
        con.execute("INSERT INTO t(rowid, title, description, tags, body) VALUES (?,?,?,?,?)",
                    (i, ti, de, json.dumps(tg, separators=(",", ":")), bo))
    q = query.replace('"', "").replace("'", "")
    match = '"' + '" OR "'.join(q.split()) + '"'
    return dict(con.execute("SELECT rowid, bm25(t, 0) FROM t WHERE t MATCH ?", (match,)).fetchall())


@pytest.mark.parametrize("query", QUERIES)
def test_bm25_equals_fts5(spark, query):
    concepts = spark.createDataFrame(
        [(i, f"s{i}", "reference", ti, de, tg, bo) for i, ti, de, tg, bo in DOCS],
        "id long, slug string, type string, title string, description string, tags array<string>, body string",
    )
    idx = fts.build_index(concepts)
    q = spark.createDataFrame([(0, query)], "query_id long, query string")
    ranked = fts.bm25(idx.postings, fts.query_phrases(q), idx.stats, idx.doc_len)
    got = {r.id: r.rank for r in ranked.collect()}
    want = _fts5_ranks(query)
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


def test_hybrid_single_query_pages(spark):
    from quire.functions.embedding import embed_udf

    concepts = spark.createDataFrame(
        [(i, f"s{i}", "skill" if i % 2 else "reference", ti, de, tg, "stable", "local", len(bo), bo)
         for i, ti, de, tg, bo in DOCS],
        "id long, slug string, type string, title string, description string, tags array<string>, "
        "status string, source string, body_length int, body string",
    ).withColumn("embedding", embed_udf(F.col("body")))
    res = hybrid.search(concepts, "alpha beta", limit=2, offset=1, alpha=0.5)
    rows = res.orderBy("position").collect()
    assert [r.position for r in rows] == [1, 2]
    assert all(r.total >= 3 for r in rows)
    only_tags = hybrid.search(concepts, "alpha", tags=["x", "y"]).collect()
    assert {r.slug for r in only_tags} == {"s1"}
    none = hybrid.search(concepts, "   ", alpha=0.0).collect()
    assert none == []


def test_stored_bucketed_index_ranks_the_same(spark):
    import uuid

    from quire.session import checkpoint_dir

    concepts = spark.createDataFrame(
        [(i, f"s{i}", "reference", ti, de, tg, bo) for i, ti, de, tg, bo in DOCS],
        "id long, slug string, type string, title string, description string, tags array<string>, body string",
    )
    idx = fts.build_index(concepts)
    name = "postings_" + uuid.uuid4().hex[:8]
    stored = fts.write_postings_table(idx.postings, name, f"{checkpoint_dir(spark)}/{name}", 4)
    q = spark.createDataFrame([(0, "alpha beta-gamma"), (1, "delta")], "query_id long, query string")
    ph = fts.query_phrases(q)
    a = {(r.query_id, r.id): r.rank for r in fts.bm25(stored, ph, idx.stats).collect()}
    b = {(r.query_id, r.id): r.rank for r in fts.bm25(idx.postings, ph, idx.stats).collect()}
    assert set(a) == set(b) and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in b)
    plan = fts.bm25(stored, ph, idx.stats)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan


def test_empty_corpus_search_is_empty(spark):
    concepts = spark.createDataFrame(
        [], "id long, slug string, type string, title string, description string, tags array<string>, "
            "status string, source string, body_length int, body string, embedding array<float>",
    )
    assert hybrid.search(concepts, "alpha beta").collect() == []


def test_knn_query_blocks_match_brute_force(spark, monkeypatch):
    import numpy as np

    from quire.operators import vector

    monkeypatch.setattr(vector, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(1)
    docs = rng.normal(size=(40, 8)).astype(np.float32)
    docs[5] = 0  # zero vector: left out
    qs = rng.normal(size=(7, 8)).astype(np.float32)
    corpus = spark.createDataFrame(
        [(i, f"d{i:02d}", "skill" if i % 2 else "agent", docs[i].tolist()) for i in range(40)],
        "id long, slug string, type string, embedding array<float>",
    )
    queries = spark.createDataFrame(
        [(j, qs[j].tolist(), 4, ["skill"] if j % 3 == 0 else []) for j in range(7)],
        "query_id long, qvec array<float>, k int, types array<string>",
    )
    got = {(r.query_id, r.vec_pos): r.id for r in vector.knn(corpus, queries, types_col="types").collect()}
    d64, q64 = docs.astype(np.float64), qs.astype(np.float64)
    for j in range(7):
        cand = [i for i in range(40) if i != 5 and (j % 3 != 0 or i % 2 == 1)]
        dist = {i: 1 - d64[i] @ q64[j] / (np.linalg.norm(d64[i]) * np.linalg.norm(q64[j])) for i in cand}
        want = sorted(cand, key=lambda i: (round(dist[i], 12), f"d{i:02d}"))[:4]
        assert [got[(j, p)] for p in range(1, 5)] == want


SCRIPTS = ["हिन्दी में लिखा पाठ", "שָׁלוֹם עֲלֵיכֶם", "مَرْحَبًا بِكُمْ", "e\u0301tude cafe\u0301", "a\u0305b o\u031bn", "ΑΒΓ ἄνθρωπος", "ﬁn Straße İstanbul"]


@pytest.mark.parametrize("text", SCRIPTS)
def test_tokens_of_other_scripts_equal_fts5(spark, text):
    from quire.functions.text import fts_tokens

    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='unicode61')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    con.execute("INSERT INTO t VALUES (?)", (text,))
    want = [r[0] for r in con.execute("SELECT term FROM v ORDER BY offset")]
    assert spark.createDataFrame([(text,)], "x string").select(fts_tokens(F.col("x"))).first()[0] == want


def _occurrences_by_hand(rows, phrases):
    """(phrase, id, field) -> occurrences: starts with as many postings of the phrase's tokens as it has tokens."""
    out = {}
    for name, toks in phrases.items():
        votes = {}
        for i, field, pos, term in rows:
            for j, t in enumerate(toks):
                if t == term:
                    votes[i, field, pos - j] = votes.get((i, field, pos - j), 0) + 1
        for (i, field, _), k in votes.items():
            if k == len(toks):
                out[name, i, field] = out.get((name, i, field), 0) + 1
    return out


def test_phrase_hits_vote_by_neighbours(spark, monkeypatch):
    """The hits of token votes, ids of several rows included, while only neighbours are joined and tasks stay bounded."""
    import random

    rng = random.Random(5)
    words = ["the", "of", "a", "tip", "Été"]
    docs = [(n % 17, f"s{n % 17}", "note", "the tip", None, ["of", "a"] if n % 3 else None,
             " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for n in range(19)]
    docs += [docs[4], (99, "empty", "note", None, None, [], "")]
    schema = "id long, slug string, type string, title string, description string, tags array<string>, body string"
    concepts = spark.createDataFrame(docs, schema)
    monkeypatch.setattr(fts, "MATCH_DOCUMENTS", 2)
    n = fts.match_partitions(concepts)
    assert n == 11
    postings = fts.build_postings(concepts, n)
    assert postings.rdd.getNumPartitions() == 11
    queries = spark.createDataFrame(
        [(1, "the"), (2, "the-of the the"), (3, "a-a-a ete"), (4, "tip-the-of-a"), (5, "  "), (6, "none-the"), (None, "of-\u00e9t\u00e9")],
        "query_id long, query string")
    phrases = fts.query_phrases(queries)
    kinds = {(r.query_id, r.phrase_idx): r.toks for r in phrases.collect()}
    rows = [(r.id, r.field, r.pos, r.term) for r in postings.collect()]
    want = sorted((str(q), p, i, f, k) for ((q, p), i, f), k in _occurrences_by_hand(rows, kinds).items())
    for stored in (postings, postings.drop("prev", "repeated")):  # as a table without them votes with every token
        hits = fts.phrase_hits(stored, phrases)
        assert sorted((str(r.query_id), r.phrase_idx, r.id, r.field, r.occ) for r in hits.collect()) == want
    pair = fts.query_phrases(spark.createDataFrame([(1, "the-the")], "query_id long, query string"))
    keys = fts._phrase_keys(pair)
    plan = fts.phrase_occurrences(postings, keys, True)._jdf.queryExecution().optimizedPlan().toString()
    assert "(prev#" in plan and "Window" in plan
    assert "Window" not in postings.select("id", "term")._jdf.queryExecution().optimizedPlan().toString()
