"""The stored index: search equals the unpruned ranking, maintenance equals a rebuild."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from quire.operators import fts, hybrid, search_index
from quire.session import checkpoint_dir

WORDS = ["spark", "plan", "join", "hash", "état", "naïve", "tree", "leaf", "the", "of", "a", "x1", "skew", "range", "tip-top", "north-west"]
DDL = "id long, slug string, type string, title string, description string, tags array<string>, body string"


def concepts(spark, n, seed=1, first=0):
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choice(WORDS[: rng.randint(2, len(WORDS))]) for _ in range(rng.randint(0, k)))
    rows = [(2**53 + 1 + i, f"s{i:05d}", rng.choice(["skill", "agent", "note"]), text(3), text(6) or None, text(2).split() or None, text(40))
            for i in range(first, first + n)]
    return spark.createDataFrame(rows, DDL)


def queries(spark):
    rows = [(1, "spark", None, 3), (2, "the of a", None, 5), (3, "tip-top north-west join", None, 10), (4, "skew skew range", ["agent"], 4),
            (5, "", None, 5), (6, "unknown", None, 5), (7, "Etat NAIVE 'x1' \"tree\"", ["skill", "note"], 50), (8, "leaf-leaf", None, 1),
            (9, " ".join(WORDS), None, 400)]
    ddl = "query_id long, query string, type array<string>, cut int"
    q = hybrid.with_defaults(spark.createDataFrame(rows, ddl).selectExpr(
        "query_id", "query", "type", "cast(null as array<string>) as tags", "cast(null as double) as alpha", "cast(null as int) as limit",
        "cast(null as int) as offset", "cut"))
    return q.drop("cand").join(spark.createDataFrame([(r[0], r[3]) for r in rows], "query_id long, cand int"), "query_id")


def unpruned(c, q):
    """The ranking from all postings."""
    idx = fts.build_index(c)
    ranked = fts.attach_docs(fts.bm25(idx.postings, fts.query_phrases(q.select("query_id", "query")), idx.stats, idx.docs), idx.docs)
    return fts.top_by_rank(ranked.join(q.select("query_id", "cand", "types"), "query_id"), "cand", "types")


def rows_of(df):
    return sorted((r.query_id, r.fts_pos, r.id, r.slug, round(r["rank"], 9) + 0.0) for r in df.select("query_id", "fts_pos", "id", "slug", "rank").collect())


def folder(spark):
    return f"{checkpoint_dir(spark).rstrip('/')}/search-{uuid.uuid4().hex}"


@pytest.mark.parametrize("range_docs,direct,probe", [(1000, 64, 4), (16, 0, 1)])
def test_search_equals_the_unpruned_ranking(spark, range_docs, direct, probe):
    c, q = concepts(spark, 150), queries(spark)
    index = search_index.build(c, folder(spark), range_docs=range_docs)
    assert index.n_docs == 150 and (range_docs > 100 or index.n_ranges > 5)
    assert rows_of(search_index.top_documents(index, q, direct=direct, probe=probe)) == rows_of(unpruned(c, q))


def test_maintained_index_equals_a_rebuild(spark):
    base, q = folder(spark), queries(spark)
    stored = concepts(spark, 120)
    index = search_index.build(stored, base, range_docs=16)
    for run in range(4):
        rng = random.Random(run)
        drop = [2**53 + 1 + i for i in rng.sample(range(120 + 20 * run), 9)]
        gone = stored.where(F.col("id").isin(drop))
        back = gone.where(F.col("id") % 2 == 0).withColumn("body", F.concat("body", F.lit(f" changed run{run} tree")))
        fresh = back.unionByName(concepts(spark, 20, seed=100 + run, first=120 + 20 * run))
        stored = spark.createDataFrame(stored.where(~F.col("id").isin(drop)).unionByName(fresh).collect(), DDL)
        index = search_index.refresh(base, gone, spark.createDataFrame(fresh.collect(), DDL), range_docs=16, fan=3, tag=f"run{run}")
        assert index.n_docs == stored.count()
    again = search_index.refresh(base, gone, fresh, range_docs=16, fan=3, tag="run3")
    assert [s["seg"] for s in again.segments] == [s["seg"] for s in index.segments]  # a repeated run changes nothing
    assert len(index.segments) < 5
    want = fts.build_index(stored)
    assert sorted(map(tuple, index.docs().select("id", "slug", "type", "doc_len").collect())) == sorted(
        map(tuple, want.docs.select("id", "slug", "type", "doc_len").collect())) + sorted(
        (r.id, r.slug, r.type, 0) for r in stored.join(want.docs, "id", "left_anti").collect())
    counts = want.postings.groupBy("term").agg(F.countDistinct("id").alias("d"), F.count("*").alias("o"))
    assert sorted(map(tuple, index.term_counts().collect())) == sorted(map(tuple, counts.collect()))
    assert index.avg_len == pytest.approx(want.stats.first().avg_len)
    assert rows_of(search_index.top_documents(index, q, direct=0, probe=1)) == rows_of(unpruned(stored, q))


def test_search_reads_the_folders_of_its_terms_only(spark):
    index = search_index.build(concepts(spark, 60), folder(spark), range_docs=16)
    q = queries(spark).where("query_id = 1")
    plan = search_index.top_documents(index, q)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(tb#" in plan or "PartitionFilters: [(tb#" in plan or "tb#" in plan.split("PartitionFilters")[1][:200]


def test_empty_index_and_empty_queries(spark):
    base = folder(spark)
    assert search_index.open_index(spark, base).n_docs == 0
    index = search_index.build(concepts(spark, 0), base)
    assert search_index.top_documents(index, queries(spark)).collect() == []
    index = search_index.refresh(base, concepts(spark, 0), concepts(spark, 5))
    assert index.n_docs == 5 and search_index.top_documents(index, queries(spark).limit(0)).collect() == []
    index = search_index.refresh(base, concepts(spark, 5), concepts(spark, 0))
    assert index.n_docs == 0 and search_index.top_documents(index, queries(spark)).collect() == []


def test_runs_and_streams_keep_the_index(spark):
    import quire
    from support import files_df
    from quire.plans import index_run
    from quire.sources import snapshot
    from quire.streaming import ingest

    base = folder(spark)
    snap, idx = base + "/concepts", base + "/search"

    def found(word):
        concepts = snapshot.read_snapshot(spark, snap)
        return sorted(r.slug for r in quire.search(concepts, word, alpha=0.0, index=quire.open_index(spark, idx)).collect())

    index_run.run_index(files_df(spark, [("/kb/a.md", "old spark text"), ("/kb/b.md", "other text")]), ["/kb"], snap, now=1, index_base=idx)
    assert found("spark") == ["kb/a"] and found("text") == ["kb/a", "kb/b"]
    index_run.run_index(files_df(spark, [("/kb/a.md", "plain text"), ("/kb/c.md", "spark tree")]), ["/kb"], snap, now=2, index_base=idx)
    assert found("spark") == ["kb/c"] and found("text") == ["kb/a"]
    batch = spark.createDataFrame([("/kb/c.md", None, 4), ("/kb/d.md", "spark again", 4)], ingest.RECORD_DDL)
    for _ in range(2):
        ingest.process_batch(batch, 0, ["/kb"], snap, base + "/runs", now=3, index_base=idx)
    assert found("spark") == ["kb/d"] and quire.open_index(spark, idx).n_docs == 2


def test_a_task_writes_one_file_of_bounded_ranges(spark):
    from quire.operators.search_index import FILE_RANGES, STORED_DDL, _write_segment
    from quire.plans.index_run import scratch_base

    ranges = 150
    blocks = spark.range(ranges * 40).selectExpr("id % 150 AS rng", "concat('t', id div 150) AS term", "1 AS n", "1D AS max_f", "1 AS min_len",
                                                 "array(0) AS slots", "array(1D) AS f", "array(0L) AS at")
    path = scratch_base(spark, "t-files")
    _write_segment(blocks, path, ranges)
    stored = spark.read.schema(STORED_DDL).parquet(path).select("tb", "rng", F.col("_metadata.file_path").alias("file"))
    files = stored.groupBy("tb", "file").agg(F.count_distinct("rng").alias("n"), F.count("*").alias("rows")).collect()
    assert max(r.n for r in files) <= FILE_RANGES and sum(r.rows for r in files) == ranges * 40
    tasks = [r.file.rsplit("/", 1)[1].split("-")[1] for r in files]
    assert len(set(tasks)) == len(tasks)  # the task's number: none wrote two folders' files
