"""The driver contract: entry, queries and oracle SQL stay consistent."""

import duckdb

import __spark_entry__ as E
from support import SF0001


def test_entry_runs_on_smallest_tables(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "slug" in df.columns and "total" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_oracles_parse_in_duckdb():
    con = duckdb.connect()
    for t in ["documents", "benchmark", "embeddings", "conversations"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    for name, sql in E.oracle_sql().items():
        con.execute("EXPLAIN " + sql)


def test_some_plans_match_oracle_on_smallest_tables(spark):
    from checks.compare import rows_of

    con = duckdb.connect()
    for t in ["documents", "benchmark", "embeddings", "conversations"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    for name in ["stats_by_type", "list_concepts", "bm25_topk", "hybrid_search", "resolve_dependencies",
                 "diff_snapshot"]:
        df = E.queries()[name](spark, SF0001)
        res = con.execute(E.oracle_sql()[name])
        cols = [d[0] for d in res.description]
        assert sorted(df.columns) == sorted(cols), name
        assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, res.fetchall()), name
