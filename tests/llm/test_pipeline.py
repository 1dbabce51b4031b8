import re
from collections import Counter

import corpus_pipeline as P
from support import SF0001
from quire.llm import bin_pack, compress_quality


def test_stages_on_the_smallest_tables(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    rows = docs.collect()
    seen = {"start": {r.doc_id: r for r in rows}}
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF0001)
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = P.materialize(out, "test")
        seen[name] = docs.collect()
    kept = [{r.doc_id for r in seen[n]} for n in ("quality", "dedup", "leaks")]
    assert kept[0] > kept[1] >= kept[2]
    items = [r.text for r in spark.read.parquet(f"{SF0001}/benchmark.parquet").collect()]
    holds = lambda t: any(i in t for i in items)
    assert not any(holds(r.text) for r in seen["leaks"])
    assert any(holds(r.text) for r in seen["dedup"])
    texts = [re.sub(r"\s+", " ", r.text.lower()).strip() for r in seen["dedup"]]
    assert len(set(texts)) == len(texts)
    assert set(r.doc_id for r in seen["mix"]) <= kept[2]
    assert max(Counter(r.doc_id for r in seen["mix"]).values()) <= 3
    assert Counter(r.doc_id for r in seen["shards"]) == Counter(r.doc_id for r in seen["mix"])
    assert {r.shard for r in seen["shards"]} <= set(range(16))


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF0001).collect() == []


def test_module_names_are_those_of_the_query():
    assert [n for n, _ in P.STAGES] == ["quality", "dedup", "leaks", "mix", "shards"]
    assert bin_pack.QUERIES and compress_quality.QUERIES


def test_rows_are_judged_by_their_own_text(spark):
    item = spark.read.parquet(f"{SF0001}/benchmark.parquet").orderBy("item_id").first().text
    plain = "a row with enough words of its own to have a few shingles to compare with others"
    other = "wholly different text that stands under the same number as another one does here"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    make = lambda pairs: spark.createDataFrame([(i, t, "en", "s", 1) for i, t in pairs], schema)
    left = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    rows = make([(None, item), (1, plain), (2, other), (2, f"x {item} y"), (None, plain)])
    assert left(P.leaks(spark, rows, SF0001)) == sorted([(1, plain), (2, other), (None, plain)], key=str)
    rows = make([(None, plain), (5, plain), (5, plain), (5, other), (4, plain), (None, item), (None, item), (6, None), (7, "")])
    assert left(P.dedup(spark, rows, SF0001)) == sorted([(4, plain), (5, other), (None, item), (6, None), (7, "")], key=str)


def test_row_keys_tell_pairs_apart_even_where_hashes_meet(spark):
    rows = [(1, "a"), (1, "b"), (2, "a"), (None, "a"), (None, None), (2, None), (3, ""), (3, "null"), (1, "a"), (None, None)]
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], "doc_id long, text string, row_key int, sign int")
    for bits in (63, 2, 1):
        keyed = P.rows_of(df, "key", bits).collect()
        by_key = {}
        for r in keyed:
            by_key.setdefault(r.key, set()).add((r.doc_id, r.text))
            assert (r.row_key, r.sign) == (5, 6)
        assert len(keyed) == len(rows) and len(by_key) == len(set(rows)) and all(len(v) == 1 for v in by_key.values())


def test_input_columns_of_any_name_and_very_long_texts_pass_through(spark):
    long = " ".join(f"word{i}" for i in range(200_000))
    rows = [(i, f"a plain document number {i} that says something of its own in words {i * 7}", "s", 77, 1.5) for i in range(6)] + [(9, long, "s", 77, 1.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row_key long, score double")
    for stage in (P.dedup, P.leaks):
        assert sorted(map(tuple, stage(spark, df, SF0001).collect())) == sorted(rows)
    assert {(r.row_key, r.score) for r in P.mix(spark, df, SF0001).collect()} == {(77, 1.5)}
    got = P.shards(spark, df, SF0001).collect()
    assert {(r.doc_id, r.row_key, r.score) for r in got} == {(r[0], 77, 1.5) for r in rows}
