"""Benchmark the headline plans; prints ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each timed step runs its whole plan to completion (noop sink or collect of a
small result).  Python workers and the JVM are warmed on the smallest data
set first so the first timed step does not pay process start-up.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from quire.session import local_session  # noqa: E402


def timed(fn):
    t0 = time.perf_counter()
    out = fn()
    return time.perf_counter() - t0, out


def run_noop(df):
    df.write.format("noop").mode("overwrite").save()


def embed_inside(df, column: str) -> float:
    """Microseconds per text that embedding itself takes inside the executors, without Spark around it."""
    def run(batches):
        import pandas as pd

        from quire.functions.embedding import embed_many

        for pdf in batches:
            t0 = time.perf_counter()
            embed_many(pdf["text"])
            yield pd.DataFrame({"s": [time.perf_counter() - t0], "n": [len(pdf)]})

    total = df.select(F.col(column).alias("text")).mapInPandas(run, "s double, n long").agg(F.sum("s"), F.sum("n")).first()
    return round(1e6 * total[0] / max(total[1], 1), 1)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores=cpus, shuffle_partitions=max(cpus, 2))
    from quire.operators import fts, graph, hybrid, search_index
    from quire.functions.embedding import embed_udf
    from quire.plans import catalog
    from quire.sources.fixtures import FIXTURE_ROOTS, read_table

    # Warm-up on the smallest tables (process start, codegen caches).
    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm):
        run_noop(catalog.q_hybrid_search(spark, warm))

    q: dict[str, float] = {}
    docs = read_table(spark, sf_dir, "documents")
    n_docs = docs.count()
    files = catalog.fixture_files(spark, sf_dir)

    q["embed"], _ = timed(lambda: run_noop(docs.repartition(cpus).select(embed_udf(F.col("text")).alias("e"))))
    turns = read_table(spark, sf_dir, "conversations")
    n_turns = turns.count()
    q["embed_short"], _ = timed(lambda: run_noop(turns.repartition(cpus).select(embed_udf(F.col("text")).alias("e"))))
    inside = {"doc": embed_inside(docs, "text"), "short_text": embed_inside(turns, "text")}
    q["index"], concepts = timed(lambda: catalog.fixture_concepts(spark, sf_dir))

    # Searches read the stored snapshot and the stored index; nothing is cached.
    q["build_postings"], _ = timed(lambda: run_noop(fts.build_postings(concepts)))
    q["build_index"], index = timed(lambda: catalog.stored_index(spark, sf_dir))

    def one_query():
        words = read_table(spark, sf_dir, "benchmark").orderBy("item_id").first().text
        first3 = " ".join(re.findall(r"[^\W_]+", words)[:3])
        return hybrid.search(concepts, first3, index=index).collect()

    q["hybrid_one"], _ = timed(one_query)
    batch = catalog.fixture_queries(spark, sf_dir).cache()
    n_queries = batch.count()
    q["hybrid_batch"], _ = timed(
        lambda: hybrid.search_batch(concepts, batch, index=index).collect()
    )

    def bm25_batch():
        qq = hybrid.with_defaults(batch)
        k_max = qq.agg(F.max("cand")).first()[0]
        return search_index.top_documents(index, qq, k_max=k_max).collect()

    q["bm25_batch"], _ = timed(bm25_batch)
    q["knn_embeddings"], _ = timed(lambda: catalog.q_knn_cosine(spark, sf_dir).collect())
    q["list_concepts"], _ = timed(lambda: catalog.q_list_concepts(spark, sf_dir).collect())
    q["stats_by_type"], _ = timed(lambda: catalog.q_stats_by_type(spark, sf_dir).collect())
    q["tag_counts"], _ = timed(lambda: catalog.q_tag_counts(spark, sf_dir).collect())
    q["references"], _ = timed(lambda: run_noop(graph.references(concepts)))
    q["closure"], _ = timed(lambda: graph.resolve_dependencies(concepts).count())
    q["index_previous"], _ = timed(lambda: catalog.fixture_previous(spark, sf_dir))
    q["diff_snapshot"], _ = timed(lambda: run_noop(catalog.q_diff_snapshot(spark, sf_dir)))
    q["upsert_snapshot"], _ = timed(lambda: run_noop(catalog.q_upsert_snapshot(spark, sf_dir)))

    total = sum(q.values())
    out = {
        "metric": "total_sec",
        "value": round(total, 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in q.items()},
        "sf": float(re.findall(r"sf([0-9.]+)", sf_dir)[0]) if re.findall(r"sf([0-9.]+)", sf_dir) else None,
        "docs": n_docs,
        "queries_in_batch": n_queries,
        "index_docs_per_sec": round(n_docs / q["index"], 1),
        "embed_docs_per_sec": round(n_docs / q["embed"], 1),
        "embed_us_per_doc": round(1e6 * q["embed"] / n_docs, 1),
        "embed_us_per_short_text": round(1e6 * q["embed_short"] / max(n_turns, 1), 1),
        "short_texts": n_turns,
        "embed_us_inside_executor": inside,
        "cpus": cpus,
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
