"""Incremental maintenance of the concept snapshot.

A run compares the current scan with the stored snapshot by ``file_path``
and content hash (one full outer join on the path), parses and embeds only
the files that are new or changed, and assembles the next snapshot version.
Deletes guard on ``source = 'local'``: rows synced from elsewhere survive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import paths
from quire.operators.parse import parse_files
from quire.schema import CONCEPT_COLUMNS

LOCAL = "local"


# Changed or removed paths broadcast into the carry-over anti join; above
# this many, the anti join shuffles instead.
MAX_BROADCAST_PATHS = 2_000_000


def diff_snapshot(stored: DataFrame, scan: DataFrame, roots: list[str], removals: bool = True) -> DataFrame:
    """U1+U2: ``(file_path, action, slug, id, source, created_at, last_synced_at)``.

    action: 'skipped' (same hash), 'updated', 'added', 'removed' (stored,
    local, not scanned), or 'kept' (stored, not local, not scanned).  The
    slug is the stored one for existing rows, the derived one for new rows;
    the identity columns of existing rows ride along so that the upsert
    never joins the full snapshot again.  Only narrow columns of the
    snapshot are read (path, hash, identity), never bodies or embeddings.
    A scan may hold ``content_hash`` in place of its content.
    """
    # A path that the scan holds twice is one file: the copy with the smallest hash.
    hashed = F.col("content_hash") if "content_hash" in scan.columns else F.sha2(F.col("content"), 256)
    s = scan.groupBy("file_path").agg(F.min(hashed).alias("new_hash"))
    t = stored.select(
        "file_path", F.col("file_hash").alias("old_hash"), F.col("slug").alias("old_slug"), "id", "source",
        "created_at", "last_synced_at",
    ).where(F.col("file_path").isNotNull())
    j = s.join(t, on="file_path", how="full_outer")
    in_scan = F.col("new_hash").isNotNull()
    in_store = F.col("old_hash").isNotNull() | F.col("id").isNotNull()
    action = (
        F.when(in_scan & in_store & (F.col("new_hash") == F.col("old_hash")), "skipped")
        .when(in_scan & in_store, "updated")
        .when(in_scan, "added")
        .when(F.col("source") == LOCAL, "removed" if removals else "kept")
        .otherwise("kept")
    )
    slug = F.when(in_store, F.col("old_slug")).otherwise(paths.derive_slug(F.col("file_path"), roots))
    return j.select(
        "file_path", action.alias("action"), slug.alias("slug"), "id", "source", "created_at", "last_synced_at"
    )


def _small_paths(paths_df: DataFrame) -> DataFrame:
    """Broadcast a path set when its size is proven small, else leave it."""
    n = paths_df.limit(MAX_BROADCAST_PATHS + 1).count()
    return F.broadcast(paths_df) if n <= MAX_BROADCAST_PATHS else paths_df


def upsert_snapshot(stored: DataFrame, scan: DataFrame, roots: list[str], now, removals: bool = True,
                    diff: DataFrame | None = None) -> DataFrame:
    """The next snapshot (same schema as ``stored``).

    Unchanged and foreign rows are carried over as stored (an anti join with
    the changed/removed paths: the snapshot is scanned, not shuffled);
    updated rows keep id, slug, file_path, source and created_at and take
    the new content and ``updated_at = now``; added rows get
    ``id = xxhash64(slug)``.  Only new or changed files are parsed.
    """
    d = diff_snapshot(stored, scan, roots, removals) if diff is None else diff
    replaced = d.where(F.col("action").isin("updated", "removed")).select("file_path")
    carried = stored.join(_small_paths(replaced), on="file_path", how="left_anti")
    return carried.select(*CONCEPT_COLUMNS).unionByName(fresh_rows(scan, d, roots, now))


def fresh_rows(scan: DataFrame, diff: DataFrame, roots: list[str], now) -> DataFrame:
    """The next rows of the files that a run adds or changes; only these are parsed."""
    changed = diff.where(F.col("action").isin("added", "updated"))
    to_parse = scan.join(changed.select("file_path"), on="file_path", how="left_semi")
    # Only changed files are moved; of a path's copies the one that the diff compared.
    hashed = F.sha2(F.col("content"), 256)
    once = F.struct(*[F.col(c) for c in scan.columns if c != "file_path"])
    to_parse = to_parse.groupBy("file_path").agg(F.min_by(once, hashed).alias("_file")).select("file_path", "_file.*")
    fresh = parse_files(to_parse, roots, now=now)
    old = changed.where(F.col("action") == "updated").select(
        "file_path", F.col("id").alias("_id"), F.col("slug").alias("_slug"), F.col("source").alias("_source"),
        F.col("created_at").alias("_created"), F.col("last_synced_at").alias("_synced"),
    )
    merged = fresh.join(old, on="file_path", how="left")
    return merged.select(
        *[
            F.coalesce(F.col("_id"), F.col("id")).alias("id") if c == "id"
            else F.coalesce(F.col("_slug"), F.col("slug")).alias("slug") if c == "slug"
            else F.coalesce(F.col("_source"), F.col("source")).alias("source") if c == "source"
            else F.coalesce(F.col("_created"), F.col("created_at")).alias("created_at") if c == "created_at"
            else F.col("_synced").alias("last_synced_at") if c == "last_synced_at"
            else F.col(c)
            for c in CONCEPT_COLUMNS
        ]
    )


def index_summary(diff: DataFrame, next_snapshot: DataFrame | int) -> DataFrame:
    """One row ``(added, updated, removed, skipped, total)``; the next snapshot or its number of rows."""
    counts = diff.agg(
        *[F.sum(F.when(F.col("action") == a, 1).otherwise(0)).cast("long").alias(a)
          for a in ("added", "updated", "removed", "skipped")]
    )
    known = isinstance(next_snapshot, int)
    total = F.lit(next_snapshot).cast("long") if known else next_snapshot.select(F.count(F.lit(1))).scalar()
    return counts.select("added", "updated", "removed", "skipped", total.alias("total"))


def partial_scan(files: DataFrame, directory: str) -> DataFrame:
    """U4 (directory form): the files a walk of ``directory`` finds."""
    return files.where(F.col("file_path").rlike(paths.walk_regex([directory])))


def path_diff(stored: DataFrame, scan: DataFrame, path: str, roots: list[str]) -> DataFrame:
    """U4 (all forms): the diff of one path, without the rows it leaves alone.

    A file (``scan`` holds the path itself) is compared as is, whatever its name, and
    takes its slug from ``roots``; a directory is walked and takes slugs from itself;
    a path that is neither removes the local row stored under it.
    """
    path = path.rstrip("/") or "/"
    single = scan.where(F.col("file_path") == path)
    file = diff_snapshot(stored.where(F.col("file_path") == path), single, roots, removals=True)
    below = diff_snapshot(stored, partial_scan(scan, path), [path], removals=False)
    return file.unionByName(below).where(F.col("action") != "kept")


def deindex_slugs(stored: DataFrame, slugs: DataFrame) -> DataFrame:
    """Drop local rows whose slug is in ``slugs(slug)`` (a key batch)."""
    keys = slugs.select(F.col("slug").alias("_key")).distinct()
    return stored.join(keys, (F.col("slug") == F.col("_key")) & (F.col("source") == LOCAL), how="left_anti")


def like_prefix(path: Column, prefix: str) -> Column:
    """``path LIKE prefix || '%'`` with SQLite's rules: ASCII case folding and
    '%' / '_' in the prefix acting as wildcards."""
    from quire.operators.graph import ascii_lower

    return ascii_lower(path).rlike(like_pattern(prefix + "%"))


def like_pattern(pattern: str) -> str:
    """The regular expression of a LIKE pattern over ASCII-lower-cased text; a backslash is itself."""
    folded = pattern.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return "(?s)^" + "".join(".*" if ch == "%" else "." if ch == "_" else _re_escape(ch) for ch in folded) + "$"


def _re_escape(ch: str) -> str:
    return "\\" + ch if ch in r".^$*+?{}[]\|()" else ch


def deindex_prefixes(stored: DataFrame, prefixes: list[str]) -> DataFrame:
    """Drop local rows whose path matches any prefix (LIKE semantics).

    Prefixes are a short user list, so this is one filter, not a join.
    """
    if not prefixes:
        return stored
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | like_prefix(F.col("file_path"), p)
    return stored.where(~(hit & (F.col("source") == LOCAL)) | F.col("file_path").isNull())


def deindex(stored: DataFrame, slugs: DataFrame | None = None,
            prefixes: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """U5+U6 together: ``(rows that stay, removed(slug))``; slugs win over prefixes, neither removes nothing."""
    if slugs is not None:
        stay = deindex_slugs(stored, slugs)
        gone = stored.where(F.col("source") == LOCAL).join(slugs.select("slug").distinct(), on="slug", how="left_semi")
    elif prefixes:
        stay = deindex_prefixes(stored, prefixes)
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | like_prefix(F.col("file_path"), p)
        gone = stored.where(hit & (F.col("source") == LOCAL))
    else:
        return stored, stored.select("slug").limit(0)
    return stay, gone.select("slug")


def slug_conflicts(snapshot: DataFrame) -> DataFrame:
    """Slugs carried by more than one path, with the paths counted."""
    return (
        snapshot.groupBy("slug")
        .agg(F.count_distinct("file_path").alias("n_paths"), F.min("file_path").alias("first_path"))
        .where(F.col("n_paths") > 1)
    )


def check_slug_conflicts(snapshot: DataFrame, on_conflict: str = "fail") -> DataFrame:
    """Fail the run before any write when a slug is claimed twice."""
    conflicts = slug_conflicts(snapshot)
    if on_conflict == "fail":
        if not conflicts.isEmpty():
            sample = [r.slug for r in conflicts.limit(5).collect()]
            raise ValueError(f"slug conflicts, e.g. {sample}")
        return conflicts
    if on_conflict == "report":
        return conflicts
    raise ValueError(f"unknown on_conflict {on_conflict!r}")
