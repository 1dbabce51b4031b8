"""Slug hierarchy and dependency graph (G1-G6) as joins over whole tables.

The reference answers one slug at a time with N+1 point lookups; here every
relation is computed for all concepts at once: prefixes are exploded and
equi-joined (no theta or LIKE joins), dependencies are an exploded edge
table, and the transitive closure is a frontier loop of shuffle joins with
the visited set, each level written to the checkpoint folder.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import approx_tokens
from quire.operators.parse import dependency_slugs
from quire.session import checkpoint_dir, discard, materialize, ship_package

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """LIKE's case folding: ASCII letters only."""
    return F.translate(c, _UPPER, _LOWER)


def slash_prefixes(slug: Column) -> Column:
    """Every proper prefix of the slug ending before a '/', root first."""
    parts = F.split(slug, "/", -1)
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda i: F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, i), "/")),
    )


def _prefix_rows(concepts: DataFrame) -> DataFrame:
    return concepts.select(
        F.col("slug").alias("child_slug"), F.col("title").alias("child_title"), F.col("type").alias("child_type"),
        F.col("source").alias("child_source"), F.posexplode(slash_prefixes(F.col("slug"))).alias("level", "prefix"),
    ).where(F.col("prefix").isNotNull())


def _keyed(df: DataFrame, slugs: DataFrame | None, column: str = "slug") -> DataFrame:
    """The rows whose ``column`` is in the key batch ``slugs(slug)``; all rows without one."""
    if slugs is None:
        return df
    return df.join(slugs.select(F.col("slug").alias(column)).distinct(), on=column, how="left_semi")


def references(concepts: DataFrame, slugs: DataFrame | None = None) -> DataFrame:
    """G1: for every concept (of the key batch), the concepts below ``slug/`` (any depth) with
    the same source; prefix matching is ASCII-case-insensitive like LIKE."""
    kids = _prefix_rows(concepts).withColumn("key", ascii_lower(F.col("prefix")))
    parents = _keyed(concepts, slugs).select("slug", "source", ascii_lower(F.col("slug")).alias("key"))
    j = parents.join(kids, on="key").where(F.col("source") == F.col("child_source"))
    return j.select(
        "slug", F.col("child_slug").alias("ref_slug"), F.col("child_title").alias("ref_title"),
        F.col("child_type").alias("ref_type"),
    )


def referenced_by(concepts: DataFrame, slugs: DataFrame | None = None) -> DataFrame:
    """Every existing proper prefix of each slug, root first (any source)."""
    pre = _prefix_rows(_keyed(concepts, slugs))
    anc = concepts.select(
        F.col("slug").alias("prefix"), F.col("title").alias("anc_title"), F.col("type").alias("anc_type")
    )
    j = pre.join(anc, on="prefix")
    return j.select(
        F.col("child_slug").alias("slug"), F.col("prefix").alias("ancestor_slug"), "anc_title", "anc_type",
        (F.col("level") + 1).alias("level"),
    )


def edges(concepts: DataFrame) -> DataFrame:
    """Declared dependency edges ``(src, dst, ord)``; non-arrays give none."""
    return concepts.select(
        F.col("slug").alias("src"), F.posexplode(dependency_slugs(concepts)).alias("ord", "dst")
    ).where(F.col("dst").isNotNull())


def dependencies(concepts: DataFrame, slugs: DataFrame | None = None) -> DataFrame:
    """Each declared dependency in order, with its title or null."""
    titles = concepts.select(F.col("slug").alias("dst"), F.col("title").alias("dep_title"))
    e = edges(_keyed(concepts, slugs)).join(titles, on="dst", how="left")
    return e.select(F.col("src").alias("slug"), F.col("dst").alias("dep_slug"), "ord", "dep_title")


def dependents(concepts: DataFrame, slugs: DataFrame | None = None) -> DataFrame:
    """For every existing concept, the concepts that declare it."""
    e = edges(concepts).select("src", "dst").distinct()
    src = concepts.select(F.col("slug").alias("src"), F.col("title").alias("dependent_title"))
    tgt = _keyed(concepts, slugs).select(F.col("slug").alias("dst"))
    j = e.join(tgt, on="dst", how="left_semi").join(src, on="src")
    return j.select(F.col("dst").alias("slug"), F.col("src").alias("dependent_slug"), "dependent_title")


def get_deps(concepts: DataFrame, slugs: DataFrame | None = None) -> DataFrame:
    """Both directions at once: ``(slug, relation, other_slug, ord, title)`` with the declared
    dependencies in order and, unordered (``ord`` null), the concepts that declare the slug."""
    deps = dependencies(concepts, slugs).select(
        "slug", F.lit("dependency").alias("relation"), F.col("dep_slug").alias("other_slug"), "ord",
        F.col("dep_title").alias("title"),
    )
    users = dependents(concepts, slugs).select(
        "slug", F.lit("dependent").alias("relation"), F.col("dependent_slug").alias("other_slug"),
        F.lit(None).cast("int").alias("ord"), F.col("dependent_title").alias("title"),
    )
    return deps.unionByName(users)


# The table of short walks may have this many times as many rows as the edges.
STRIDE_GROWTH = 16


def resolve_dependencies(concepts: DataFrame, max_rounds: int | None = None,
                         partitions: int | None = None, roots: DataFrame | None = None) -> DataFrame:
    """Every existing concept reachable from each root (of the key batch
    ``roots(slug)``, else from every concept) through declared dependencies, with its shortest depth; cycles safe, the root never listed,
    missing slugs omitted.

    Breadth-first by strides: short walks (pairs up to 2, 4, ... edges apart) are joined to longer ones while their table stays
    within ``STRIDE_GROWTH`` times the edges (a bound on the work, checked before each join; results don't depend on it).  A round then joins the frontier, the pairs at exactly the depth reached, with
    these walks, so it covers as many levels as the stride, and drops pairs already visited (anti join).  Every round
    is written to the checkpoint folder: lineage stays one round deep and a lost executor recomputes one round at most.
    """
    spark = concepts.sparkSession
    checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    existing = concepts.select(F.col("slug").alias("dst"))
    e = edges(concepts).select("src", "dst").distinct().join(existing, on="dst", how="left_semi").where("src <> dst")
    walks = materialize(e.withColumn("hops", F.lit(1)).repartition(n, "src"), "edges")
    limit, stride = STRIDE_GROWTH * max(walks.count(), 1), 1
    while max_rounds is None or 2 * stride <= max_rounds:
        # rows of the join, from the walks that end and begin at each concept: known before it runs
        ends = walks.groupBy(F.col("dst").alias("slug")).agg(F.count("*").alias("a"))
        begins = walks.groupBy(F.col("src").alias("slug")).agg(F.count("*").alias("b"))
        work = ends.join(begins, "slug").agg(F.sum(F.col("a").cast("decimal(38,0)") * F.col("b"))).first()[0]
        if (work or 0) > limit:
            break
        far = walks.select(F.col("src").alias("dst"), F.col("dst").alias("end"), F.col("hops").alias("more"))
        longer = walks.join(far, "dst").where("src <> end").select("src", F.col("end").alias("dst"), (F.col("hops") + F.col("more")).alias("hops"))
        longer = walks.unionByName(longer).groupBy("src", "dst").agg(F.min("hops").alias("hops"))
        longer = materialize(longer, "walks")
        reach = longer.agg(F.max("hops")).first()[0]
        discard(walks)
        walks = longer
        if reach is None or reach <= stride:  # nothing farther: the walks are the closure
            break
        stride *= 2
    level = walks if max_rounds is None else walks.where(F.col("hops") <= max_rounds)
    level = _keyed(level, roots, "src").select(F.col("src").alias("root"), F.col("dst").alias("slug"), F.col("hops").alias("depth"))
    levels = [materialize(level, "closure-level")]
    depth = stride
    while max_rounds is None or depth < max_rounds:
        frontier = levels[-1].where(F.col("depth") == depth)
        # The visited set is the union of the written levels: lineage
        # stays one level deep without writing the whole set every round.
        visited = _union(levels)
        step = frontier.join(walks, frontier["slug"] == walks["src"]).select(
            "root", F.col("dst").alias("slug"), (F.col("depth") + F.col("hops")).alias("depth")
        )
        step = step.where(F.col("slug") != F.col("root")).groupBy("root", "slug").agg(F.min("depth").alias("depth"))
        if max_rounds is not None:
            step = step.where(F.col("depth") <= max_rounds)
        nxt = step.join(visited.select("root", "slug"), on=["root", "slug"], how="left_anti")
        nxt = materialize(nxt, "closure-level")
        depth += stride
        if nxt.isEmpty():
            break
        levels.append(nxt)
    return _union(levels)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def positions(df: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """``df`` with each row's place (from 0) in its group under ``order``.

    A range sort over all groups, counts per group and partition, and the rows counted
    inside each: no group meets in one task.
    """
    ranged = df.repartitionByRange(group, *order).withColumn("_pid", F.spark_partition_id())
    ranged = materialize(ranged, "positions")  # written, so that counts and places see the same partitions
    counts = ranged.groupBy(group, "_pid").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_pid").orderBy(*order)
    placed = ranged.withColumn("_at", F.row_number().over(inside) - 1).join(starts, [group, "_pid"])
    return placed.withColumn(out, (F.col("_start") + F.col("_at")).cast("long")).drop("_pid", "_at", "_start")


# Digits of a dependency's place in its list, in a path key.
_PLACE_DIGITS = 6

# A walk holds the whole graph as numbers in every Python worker (8 bytes per edge, 8 per concept): up to so many edges.
MAX_WALK_EDGES = 8_000_000

# Rows of a tree that a walk gathers before it hands them on.
_WALK_ROWS = 1 << 16


def dependency_tree(concepts: DataFrame, roots: DataFrame | None = None, max_walk_edges: int | None = None) -> DataFrame:
    """The nested depth-first tree of every root (of the key batch ``roots(slug)``, else of all concepts with dependencies).

    ``root, position, slug, parent, depth``: what a depth-first walk with one visited set per root
    reaches, in the order in which it is entered (the root at 0).  Dependencies are walked in their declared order; missing slugs and those
    entered before are left out, so cycles end.  Concepts that several rows of one slug declare at the same place are entered
    together, by slug, before what they depend on.

    Up to ``max_walk_edges`` edges (``MAX_WALK_EDGES``, counted first) the roots are dealt over the cluster and every task walks its
    own, so the work is the size of the trees, in one stage however deep they are.  A larger graph, which no
    worker may hold, is solved by rounds of joins.
    """
    spark = concepts.sparkSession
    checkpoint_dir(spark)
    existing = concepts.select(F.col("slug").alias("dst")).distinct()
    e = edges(concepts).where("src <> dst").groupBy("src", "dst").agg(F.min("ord").alias("ord")).join(existing, "dst", "left_semi")
    e = materialize(e.select("src", "dst", "ord"), "tree-edges")
    starts = _keyed(concepts.select("slug"), roots).distinct()
    starts = starts if roots is not None else starts.join(e.select(F.col("src").alias("slug")).distinct(), "slug", "left_semi")
    limit = MAX_WALK_EDGES if max_walk_edges is None else max_walk_edges
    return _walked_tree(e, starts) if e.count() <= limit else _relaxed_tree(e, starts)


def _walked_tree(e: DataFrame, starts: DataFrame) -> DataFrame:
    """The trees of ``starts(slug)`` by a walk per root over ``e(src, dst, ord)``."""
    spark = e.sparkSession
    ship_package(spark)
    slugs = e.select(F.col("src").alias("slug")).union(e.select("dst")).distinct()
    # Numbers in the order of the slugs, without gaps.
    nodes = positions(slugs.withColumn("_all", F.lit(0)), "_all", ["slug"], "id")
    nodes = materialize(nodes.select(F.col("id").cast("int").alias("id"), "slug"), "tree-nodes")

    def named(id_name: str, slug_name: str) -> DataFrame:
        return nodes.select(F.col("id").alias(id_name), F.col("slug").alias(slug_name))

    numbered = e.join(named("s", "src"), "src").join(named("d", "dst"), "dst").select("s", F.col("ord").cast("int").alias("ord"), "d")
    lists = numbered.orderBy("s", "ord", "d").toArrow()
    s, places, targets = (lists[c].to_numpy() for c in ("s", "ord", "d"))
    first = np.searchsorted(s, np.arange(nodes.count() + 1)).astype(np.int32)
    sent = spark.sparkContext.broadcast(tuple(a.astype(np.int32).tobytes() for a in (first, places, targets)))

    def walk(batches):
        return walk_trees(sent.value, batches)

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * int(spark.sparkContext.defaultParallelism))
    begun = starts.join(named("id", "slug"), "slug").repartition(tasks, "slug")
    walked = materialize(begun.mapInArrow(walk, "root string, position long, node int, up int, depth int"), "tree")
    tree = walked.join(named("node", "slug"), "node").join(named("up", "above"), "up")
    parent = F.when(F.col("position") > 0, F.col("above"))
    tree = tree.select("root", "position", "slug", parent.alias("parent"), "depth")
    alone = starts.join(nodes, "slug", "left_anti")
    return tree.unionByName(alone.select(
        F.col("slug").alias("root"), F.lit(0).cast("long").alias("position"), "slug", F.lit(None).cast("string").alias("parent"),
        F.lit(0).alias("depth")))


def walk_trees(graph: tuple[bytes, bytes, bytes], batches):
    """Arrow batches ``(slug, id)`` of roots -> batches ``(root, position, node, up, depth)``, ``up`` being the node itself for a root.

    ``graph``: as 4-byte numbers, where each node's edges begin, and the edges' places and targets, by node, place and target.
    """
    first, places, targets = (memoryview(part).cast("i") for part in graph)
    seen = array("i", bytes(4 * (len(first) - 1)))
    stamp = 0
    root_rows, position, node, up, depth = [], [], [], [], []

    def rows():
        names = pa.DictionaryArray.from_arrays(
            pa.array([i for i, (_, n) in enumerate(root_rows) for _ in range(n)], pa.int32()), pa.array([r for r, _ in root_rows], pa.string()))
        out = pa.RecordBatch.from_arrays(
            [names.cast(pa.string()), pa.array(position, pa.int64()), pa.array(node, pa.int32()), pa.array(up, pa.int32()),
             pa.array(depth, pa.int32())], ["root", "position", "node", "up", "depth"])
        for column in (root_rows, position, node, up, depth):
            column.clear()
        return out

    for batch in batches:
        for root, start in zip(batch.column("slug").to_pylist(), batch.column("id").to_pylist()):
            stamp += 1
            seen[start] = stamp
            entered, told = 1, 0  # rows of this root: all, and those handed on
            position.append(0), node.append(start), up.append(start), depth.append(0)
            # Open lists of edges: their places, targets and sources (one number if it is one node), from where to where, depth of the targets.
            stack = [(places, targets, start, first[start], first[start + 1], 1)]
            while stack:
                place, target, source, at, end, level = stack.pop()
                while at < end and seen[target[at]] == stamp:
                    at += 1
                if at == end:
                    continue
                group, p = [], place[at]  # the targets at one place: one, unless rows of one slug differ
                while at < end and place[at] == p:
                    new = target[at]
                    if seen[new] != stamp:
                        seen[new] = stamp
                        group.append(new)
                        position.append(entered), node.append(new), depth.append(level)
                        up.append(source if type(source) is int else source[at])
                        entered += 1
                    at += 1
                if at < end:
                    stack.append((place, target, source, at, end, level))
                if len(group) == 1:
                    new = group[0]
                    stack.append((places, targets, new, first[new], first[new + 1], level + 1))
                else:
                    merged = sorted((places[i], targets[i], g) for g in group for i in range(first[g], first[g + 1]))
                    if merged:
                        stack.append((*map(list, zip(*merged)), 0, len(merged), level + 1))
                if len(position) >= _WALK_ROWS:
                    root_rows.append((root, entered - told))
                    told = entered
                    yield rows()
            if entered > told:
                root_rows.append((root, entered - told))
    if position:
        yield rows()


def _relaxed_tree(e: DataFrame, starts: DataFrame) -> DataFrame:
    """The same by rounds.

    The walk enters every concept by the path whose places in the dependency lists come first lexicographically (any
    concept that a smaller path could use is still unentered when the walk gets there).  So the tree needs no walk: each
    round extends the paths that became smaller by one edge and keeps the smallest per root and slug.  Only improved paths
    travel; a round is written to the checkpoint folder, and rounds end when no path gets smaller.
    """
    e = e.select("src", "dst", F.lpad(F.col("ord").cast("string"), _PLACE_DIGITS, "0").alias("place"))
    first = starts.select(F.col("slug").alias("root"), "slug", F.lit(None).cast("string").alias("parent"), F.lit("").alias("key"))
    best = fresh = materialize(first, "tree")
    smallest = F.min(F.struct("key", "parent")).alias("s")
    while True:
        step = fresh.join(e, fresh["slug"] == e["src"]).where("dst <> root").select(
            "root", F.col("dst").alias("slug"), F.col("src").alias("parent"), F.concat("key", "place").alias("key"))
        step = step.groupBy("root", "slug").agg(smallest).select("root", "slug", "s.parent", "s.key")
        known = best.select("root", "slug", F.col("key").alias("had"))
        nearer = materialize(step.join(known, ["root", "slug"], "left").where("had IS NULL OR key < had").drop("had"), "tree-step")
        if nearer.isEmpty():
            break
        kept = best.join(nearer.select("root", "slug"), ["root", "slug"], "left_anti")
        merged = materialize(kept.unionByName(nearer), "tree")
        discard(best, fresh)
        best, fresh = merged, nearer
    tree = positions(best, "root", ["key", "slug"], "position")
    return tree.select("root", "position", "slug", "parent", (F.length("key") / _PLACE_DIGITS).cast("int").alias("depth"))


# Columns of the concept itself, on the 'self' rows of a record.
RECORD_COLUMNS = ["id", "description", "tags", "status", "source", "timestamp", "resource", "body_length", "approx_tokens",
                  "frontmatter", "body"]


def concept_record(concepts: DataFrame, slugs: DataFrame | None = None, resolve: bool = False) -> DataFrame:
    """The full record of every concept (of the key batch) in long form.

    One row per (slug, relation, other): relation is 'self', 'reference',
    'referenced_by', 'dependency' or, with ``resolve``, 'resolved' (a reachable
    concept; ``ord`` is its depth).  'self' rows carry the concept's own fields;
    they are null elsewhere.  Long form keeps every group unbounded in rows
    rather than packed into one value.
    """
    tokens = approx_tokens(F.col("body_length")).alias("approx_tokens")
    me = _keyed(concepts, slugs).select(
        "slug", F.lit("self").alias("relation"), F.col("slug").alias("other_slug"),
        F.lit(0).alias("ord"), "title", "type", *[tokens if c == "approx_tokens" else c for c in RECORD_COLUMNS],
    )
    refs = references(concepts, slugs).select(
        "slug", F.lit("reference").alias("relation"), F.col("ref_slug").alias("other_slug"),
        F.lit(0).alias("ord"), F.col("ref_title").alias("title"), F.col("ref_type").alias("type"),
    )
    anc = referenced_by(concepts, slugs).select(
        "slug", F.lit("referenced_by").alias("relation"), F.col("ancestor_slug").alias("other_slug"),
        F.col("level").alias("ord"), F.col("anc_title").alias("title"), F.col("anc_type").alias("type"),
    )
    deps = dependencies(concepts, slugs).select(
        "slug", F.lit("dependency").alias("relation"), F.col("dep_slug").alias("other_slug"),
        F.col("ord"), F.col("dep_title").alias("title"), F.lit(None).cast("string").alias("type"),
    )
    parts = [refs, anc, deps]
    if resolve:
        named = concepts.select("slug", "title", "type").withColumnRenamed("slug", "other_slug")
        reached = resolve_dependencies(concepts, roots=slugs).select(
            F.col("root").alias("slug"), F.lit("resolved").alias("relation"), F.col("slug").alias("other_slug"),
            F.col("depth").alias("ord"),
        )
        parts.append(reached.join(named, on="other_slug").select(*refs.columns))
    out = me
    for p in parts:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
