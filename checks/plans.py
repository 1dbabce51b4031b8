"""Write the physical operator trees of key plans (``explain('formatted')``,
tree part only) to PLANS.md.  Usage: python -m checks.plans [sf_dir]"""

from __future__ import annotations

import sys

NOTES = {
    "list_concepts": "Filter pushed into the Parquet scan, read schema without body/embedding; page as "
                     "TakeOrderedAndProject(limit, offset) (per-partition top-k); total as a scalar subquery.",
    "stats_by_type": "Partial (map-side) aggregation before the one shuffle; grand total as a scalar subquery.",
    "tag_counts": "Distinct tag arrays, explode, partial aggregation; no group is collected into one value.",
    "bm25_topk": "Postings hash-partitioned by id: the broadcast phrase join, start-position vote, per-phrase "
                 "contributions and per-query sums run without Exchange; the only shuffle is the per-query top-k "
                 "window, after a partial WindowGroupLimit.",
    "knn_cosine": "MapInPandas emits each partition's per-query top-k against the broadcast query matrix; one "
                  "window takes the global top-k.  No pair table.",
    "references": "Slug prefixes exploded and equi-joined on the ASCII-lowered key; no LIKE/theta join.",
    "dependents": "Edges exploded from front matter; semi join on existing targets; equi joins.",
    "diff_snapshot": "One full outer join on file_path over narrow columns (path, hash, identity).",
    "upsert_snapshot": "Carried rows: stored snapshot anti-joined with the broadcast changed paths (scanned, not "
                       "shuffled); only added/updated files reach the Python parse/embed.",
    "hybrid_search_batch": "FTS and vector candidates per query, full outer merge on (query, id), bounded candidate "
                           "set broadcast into the concept scan for display columns; bodies fetched for page rows only.",
}


def tree(df) -> str:
    text = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    return text.split("\n\n(1)")[0].strip()


def main(argv):
    sys.path.insert(0, "/root/repo")
    from quire.plans import catalog
    from quire.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session()
    out = ["# Physical plans of key operators", "",
           f"Generated by `python -m checks.plans` on `{sf_dir}` (operator trees of `explain('formatted')`; "
           "AQE may re-plan at run time).", ""]
    for name, note in NOTES.items():
        df = catalog.QUERIES[name](spark, sf_dir)
        out += [f"## {name}", "", note, "", "```", tree(df), "```", ""]
    with open("/root/repo/PLANS.md", "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main(sys.argv[1:])
