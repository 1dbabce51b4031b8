"""Properties of the incremental operators and the graph closure."""

from pyspark.sql import functions as F

from support import SF0001, files_df
from quire.operators import graph, maintain
from quire.operators.parse import parse_files
from quire.plans import index_run
from quire.sources import snapshot
from quire.sources.fixtures import FIXTURE_ROOTS, files_from_documents, read_table


def _files(spark):
    return files_from_documents(read_table(spark, SF0001, "documents"))


def test_index_twice_skips_everything_and_reindex_restores(spark):
    files = _files(spark)
    base = index_run.scratch_base(spark, "t-index")
    _, s1 = index_run.run_index(files, FIXTURE_ROOTS, base, now=100)
    first = s1.first()
    assert first.added == first.total and first.updated == 0 and first.removed == 0
    _, s2 = index_run.run_index(files, FIXTURE_ROOTS, base, now=200)
    second = s2.first()
    assert second.skipped == first.total and second.added == 0 and second.updated == 0
    # remove a directory, then bring it back
    fewer = files.where(~F.col("file_path").startswith("/kb/agents/"))
    _, s3 = index_run.run_index(fewer, FIXTURE_ROOTS, base, now=300)
    assert s3.first().removed > 0
    path, s4 = index_run.run_index(files, FIXTURE_ROOTS, base, now=400)
    assert s4.first().added == s3.first().removed and s4.first().total == first.total
    snap = snapshot.read_version(spark, path)
    assert snap.where(F.col("created_at") == 400).count() == s4.first().added


def test_update_keeps_identity_and_remote_rows_survive(spark):
    roots = ["/kb"]
    v1 = files_df(spark, [("/kb/a.md", "---\ntitle: A\n---\none"), ("/kb/b.md", "two")])
    stored = parse_files(v1, roots, now=10).withColumn(
        "source", F.when(F.col("file_path") == "/kb/b.md", "remote").otherwise(F.col("source"))
    )
    v2 = files_df(spark, [("/kb/a.md", "---\ntitle: A2\n---\none!")])
    nxt = {r.file_path: r for r in maintain.upsert_snapshot(stored, v2, roots, now=20).collect()}
    old = {r.file_path: r for r in stored.collect()}
    assert nxt["/kb/a.md"].title == "A2" and nxt["/kb/a.md"].id == old["/kb/a.md"].id
    assert nxt["/kb/a.md"].created_at == 10 and nxt["/kb/a.md"].updated_at == 20
    assert "/kb/b.md" in nxt  # remote row not removed by the mirror


def test_deindex_prefix_wildcards_and_case(spark):
    roots = ["/kb"]
    stored = parse_files(files_df(spark, [
        ("/kb/a_b/x.md", "x"), ("/kb/aXb/y.md", "y"), ("/KB/other/z.md", "z"), ("/kb/100%/w.md", "w"),
    ]), roots, now=0, with_embedding=False)
    left = {r.file_path for r in maintain.deindex_prefixes(stored, ["/kb/a_b/"]).collect()}
    assert left == {"/KB/other/z.md", "/kb/100%/w.md"}  # '_' is a wildcard
    left = {r.file_path for r in maintain.deindex_prefixes(stored, ["/kb/o"]).collect()}
    assert "/KB/other/z.md" not in left  # ASCII case-insensitive


def test_slug_conflicts_fail_before_write(spark):
    import pytest

    files = files_df(spark, [("/a/d/x.md", "1"), ("/b/d/x.md", "2")])
    base = index_run.scratch_base(spark, "t-conflict")
    with pytest.raises(ValueError, match="slug conflicts"):
        index_run.run_index(files, ["/a", "/b"], base, now=1)
    from quire.sources import snapshot

    assert snapshot.list_versions(spark, base) == []


def test_closure_terminates_on_cycles(spark):
    rows = [
        ("/kb/a.md", "---\ndependencies: [kb/b, kb/c]\n---\n"),
        ("/kb/b.md", "---\ndependencies: [kb/c, ghost]\n---\n"),
        ("/kb/c.md", "---\ndependencies: [kb/a, kb/d]\n---\n"),
        ("/kb/d.md", "---\ndependencies: [kb/d]\n---\n"),
    ]
    concepts = parse_files(files_df(spark, rows), ["/kb"], now=0, with_embedding=False)
    got = {(r.root, r.slug): r.depth for r in graph.resolve_dependencies(concepts).collect()}
    assert got == {
        ("kb/a", "kb/b"): 1, ("kb/a", "kb/c"): 1, ("kb/a", "kb/d"): 2,
        ("kb/b", "kb/c"): 1, ("kb/b", "kb/a"): 2, ("kb/b", "kb/d"): 2,
        ("kb/c", "kb/a"): 1, ("kb/c", "kb/d"): 1, ("kb/c", "kb/b"): 2,
    }


def test_references_are_case_insensitive_and_same_source(spark):
    concepts = spark.createDataFrame(
        [("Top", "T", "skill", "local"), ("top/child", "C", "reference", "local"),
         ("top/child/leaf", "L", "reference", "local"), ("topx", "X", "skill", "local"),
         ("Top/remote", "R", "reference", "remote")],
        "slug string, title string, type string, source string",
    )
    refs = {(r.slug, r.ref_slug) for r in graph.references(concepts).collect()}
    assert refs == {("Top", "top/child"), ("Top", "top/child/leaf"), ("top/child", "top/child/leaf")}
    anc = {(r.slug, r.ancestor_slug, r.level) for r in graph.referenced_by(concepts).collect()}
    assert anc == {("top/child/leaf", "top/child", 2), ("Top/remote", "Top", 1)}


def test_deep_page_equals_take_ordered(spark):
    from quire.operators import browse

    df = spark.range(0, 5000).select(
        (F.col("id") % 97).alias("updated_at"), F.format_string("s%05d", "id").alias("slug")
    ).repartition(7)
    order = [F.col("updated_at").desc(), F.col("slug")]
    want = [r.slug for r in df.orderBy(*order).offset(1234).limit(300).collect()]
    got = browse.deep_page(df, order, 1234, 300)
    assert [r.slug for r in got.orderBy(*order).collect()] == want


def test_graph_by_key(spark):
    rows = [
        ("/kb/a.md", "---\ntitle: A\ndescription: first\ndependencies: [kb/b]\n---\nbody of a"),
        ("/kb/b.md", "---\ntitle: B\ndependencies: [kb/c, ghost]\n---\n"),
        ("/kb/c.md", "---\ntitle: C\n---\n"),
        ("/kb/d.md", "---\ntitle: D\ndependencies: [kb/a]\n---\n"),
    ]
    concepts = parse_files(files_df(spark, rows), ["/kb"], now=0, with_embedding=False)
    key = spark.createDataFrame([("kb/a",), ("kb/a",), ("missing",)], "slug string")
    reached = {(r.root, r.slug, r.depth) for r in graph.resolve_dependencies(concepts, roots=key).collect()}
    assert reached == {("kb/a", "kb/b", 1), ("kb/a", "kb/c", 2)}
    deps = {(r.slug, r.relation, r.other_slug, r.title) for r in graph.get_deps(concepts, key).collect()}
    assert deps == {("kb/a", "dependency", "kb/b", "B"), ("kb/a", "dependent", "kb/d", "D")}
    record = graph.concept_record(concepts, key, resolve=True).collect()
    assert {(r.slug, r.relation, r.other_slug, r.title) for r in record} == {
        ("kb/a", "self", "kb/a", "A"), ("kb/a", "dependency", "kb/b", "B"),
        ("kb/a", "resolved", "kb/b", "B"), ("kb/a", "resolved", "kb/c", "C")}
    me = next(r for r in record if r.relation == "self")
    assert (me.body, me.description, me.body_length, me.approx_tokens, me.source) == ("body of a", "first", 9, 2, "local")


def test_path_diff_and_deindex(spark):
    from quire.operators import maintain

    roots = ["/kb"]
    old = [("/kb/a.md", "1"), ("/kb/gone.md", "2"), ("/kb/n/x.md", "3"), ("/kb/n/y.md", "4")]
    stored = parse_files(files_df(spark, old), roots, now=0, with_embedding=False).withColumn(
        "last_synced_at", F.lit(None).cast("long"))
    scan = files_df(spark, [("/kb/a.md", "new"), ("/kb/n/x.md", "3"), ("/kb/n/z.md", "5"), ("/kb/README.md", "r")])

    def actions(path):
        return {(r.file_path, r.action) for r in maintain.path_diff(stored, scan, path, roots).collect()}

    assert actions("/kb/a.md") == {("/kb/a.md", "updated")}
    assert actions("/kb/README.md") == {("/kb/README.md", "added")}
    assert actions("/kb/gone.md") == {("/kb/gone.md", "removed")}
    assert actions("/kb/n/") == {("/kb/n/x.md", "skipped"), ("/kb/n/z.md", "added")}
    assert actions("/kb/never.md") == set()

    def left(**how):
        stay, gone = maintain.deindex(stored, **how)
        return sorted(r.slug for r in stay.collect()), sorted(r.slug for r in gone.collect())

    slugs = sorted(r.slug for r in stored.collect())
    key = spark.createDataFrame([(slugs[0],)], "slug string")
    assert left() == (slugs, [])
    assert left(slugs=key, prefixes=["/kb/"]) == (slugs[1:], slugs[:1])
    stay, gone = left(prefixes=["/KB/n/"])
    assert len(stay) == 2 and len(gone) == 2


def depth_first(deps, root):
    """(position, slug, parent, depth) of a recursive walk with one visited set."""
    out, seen = [], set()

    def enter(slug, parent, depth):
        seen.add(slug)
        out.append((root, len(out), slug, parent, depth))
        for d in deps[slug]:
            if d in deps and d not in seen:
                enter(d, slug, depth + 1)

    enter(root, None, 0)
    return out


def test_dependency_tree_equals_a_depth_first_walk(spark):
    import json
    import random

    rows, want, batches = [], [], []
    for g in range(6):  # one table of several random graphs, cycles and missing slugs included
        rng = random.Random(g)
        names = [f"g{g}n{i}" for i in range(rng.randint(1, 12))]
        deps = {n: [rng.choice(names + [f"ghost{g}"]) for _ in range(rng.randint(0, 4))] for n in names}
        rows += [(n, json.dumps({"dependencies": d})) for n, d in deps.items()]
        for n in names:
            want += depth_first(deps, n) if set(deps[n]) & set(names) - {n} else []
        batches.append((names[0], depth_first(deps, names[0])))
    concepts = spark.createDataFrame(rows, "slug string, frontmatter string")
    assert sorted(map(tuple, graph.dependency_tree(concepts).collect()), key=str) == sorted(want, key=str)
    keys = spark.createDataFrame([(n,) for n, _ in batches] + [("missing",)], "slug string")
    got = sorted(map(tuple, graph.dependency_tree(concepts, keys).collect()), key=str)
    assert got == sorted([r for _, w in batches for r in w], key=str)


def test_dependency_tree_of_a_long_chain_takes_few_steps(spark, monkeypatch):
    """As many stages for a deep tree as for a flat one, and the same rows as by rounds of joins."""
    import json

    n = 12
    deps = {f"c{i}": [f"c{i + 1}", f"c{i - 3}", "ghost"] for i in range(n)}
    concepts = spark.createDataFrame([(s, json.dumps({"dependencies": d})) for s, d in deps.items()], "slug string, frontmatter string")
    steps, write = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name="stage": steps.append(name) or write(df, name))
    root = spark.createDataFrame([("c0",)], "slug string")
    got = sorted(map(tuple, graph.dependency_tree(concepts, root).collect()))
    assert got == depth_first(deps, "c0") and got[-1][-1] == n - 1
    assert len(steps) < 6
    assert sorted(map(tuple, graph.dependency_tree(concepts, root, max_walk_edges=0).collect())) == got


def test_dependency_trees_walked_equal_those_by_rounds(spark, monkeypatch):
    """Also where rows of one slug declare other lists, roots have no dependencies, and trees are handed on in parts."""
    import json
    import random

    monkeypatch.setattr(graph, "_WALK_ROWS", 3)
    rows = []
    for g in range(12):
        rng = random.Random(g)
        names = [f"g{g}n{i}" for i in range(rng.randint(1, 10))]
        for n in names + rng.sample(names, len(names) // 2):
            rows.append((n, json.dumps({"dependencies": [rng.choice(names + ["ghost", None]) for _ in range(rng.randint(0, 4))]})))
    rows += [(None, json.dumps({"dependencies": ["g1n0"]})), ("none", None), ("text", "{\"dependencies\": \"g1n0\"}")]
    concepts = spark.createDataFrame(rows, "slug string, frontmatter string")
    for roots in (None, concepts.select("slug").where("slug IS NULL OR slug LIKE '%n%'")):
        walked, relaxed = (graph.dependency_tree(concepts, roots, n) for n in (None, 0))
        assert walked.schema.simpleString() == relaxed.schema.simpleString()
        assert sorted(map(tuple, walked.collect()), key=str) == sorted(map(tuple, relaxed.collect()), key=str)
    plain = concepts.where("slug = 'none'")
    assert graph.dependency_tree(plain).count() == 0
    assert list(map(tuple, graph.dependency_tree(plain, plain).collect())) == [("none", 0, "none", None, 0)]


def test_closure_by_strides_equals_breadth_first_search(spark, monkeypatch):
    import json
    import random

    rows, want, limited = [], set(), set()
    for g in range(8):
        rng = random.Random(g)
        names = [f"g{g}n{i}" for i in range(rng.randint(1, 25))]
        deps = {n: [rng.choice(names + ["ghost"]) for _ in range(rng.choice([0, 1, 1, 2]))] for n in names}
        if g == 0:  # a long chain
            deps = {n: [m] for n, m in zip(names, names[1:] + ["ghost"])}
        rows += [(n, json.dumps({"dependencies": d})) for n, d in deps.items()]
        for root in names:
            seen, level, depth = {root}, [root], 0
            while level:
                depth += 1
                level = sorted({d for n in level for d in deps[n] if d in deps} - seen)
                seen |= set(level)
                want |= {(root, n, depth) for n in level}
                limited |= {(root, n, depth) for n in level if depth <= 3}
    concepts = spark.createDataFrame(rows, "slug string, frontmatter string")
    for growth in (16, 2, 0):
        monkeypatch.setattr(graph, "STRIDE_GROWTH", growth)
        assert {tuple(r) for r in graph.resolve_dependencies(concepts).collect()} == want
    assert {tuple(r) for r in graph.resolve_dependencies(concepts, max_rounds=3).collect()} == limited
