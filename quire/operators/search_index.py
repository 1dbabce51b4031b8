"""The stored full-text index (F2) and ranked search on it.

Documents are dealt to *ranges* of about ``RANGE_DOCS``.  The index has one row per
term and range, a *block*: the slots (places in the range) of the documents that
hold the term, their weighted frequencies, all positions, and two bounds, the
largest frequency and the shortest document.  Blocks are stored by a hash of the term, so
that a batch of queries opens the folders of its own terms only, sorted by term within a file; a
frequent term is many blocks, dealt over the files of its folder by range.  A header row per range holds its
documents' id, slug, type and length.

A query's best possible score in a range follows from the blocks' bounds alone.  Large
indexes are searched in two steps: the most promising ranges of each query give a
threshold (its k-th best score there), and of the others only those that can reach it are read and scored.  Scoring
runs range by range, where blocks and the queries that ask for them meet, with array arithmetic.

The index is maintained by runs: a run writes a new immutable *segment* with its added
and changed documents and *tombstones* for the documents that it replaced or removed.
A manifest (one small Parquet version per run) names the segments and tombstones that count.  When ``FAN`` segments of
about equal size have gathered, they are merged into one without their dead documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import fts_tokens
from quire.operators import fts
from quire.schema import BM25_B, BM25_K1, BM25_MIN_IDF, FTS_FIELDS, FTS_WEIGHTS
from quire.session import materialize
from quire.sources import snapshot

RANGE_DOCS = 1024
BUCKETS = 16
FAN = 4
# Up to this many ranges all are scored at once; above it the most promising ``PROBE`` of a query come first.
DIRECT_RANGES = 64
PROBE = 4
HEADER = -1  # the folder of the header rows
FILE_RANGES = 64  # ranges in a file of a folder

BLOCK_DDL = ("rng long, term string, n int, max_f double, min_len int, slots array<int>, f array<double>, at array<long>, "
             "ids array<long>, slugs array<string>, types array<string>, lens array<int>")
STORED_DDL = BLOCK_DDL + ", seg int, tb int"
MANIFEST_DDL = "kind string, seg int, path string, n_docs long, n_tokens long, n_ranges long"
# A position is slot, field (2 bits) and place in the field (32 bits).
FIELD_BITS, PLACE_BITS = 2, 32


# ---------------------------------------------------------------- blocks

def term_bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _header(rng: int, ids, slugs, types, lens) -> pa.RecordBatch:
    n = len(ids)
    one = lambda a, kind: pa.array([a.to_pylist() if isinstance(a, pa.Array) else list(a)], pa.list_(kind))
    none = lambda kind: pa.nulls(1, kind)
    return pa.RecordBatch.from_arrays(
        [pa.array([rng], pa.int64()), none(pa.string()), pa.array([n], pa.int32()), none(pa.float64()), none(pa.int32()),
         none(pa.list_(pa.int32())), none(pa.list_(pa.float64())), none(pa.list_(pa.int64())), one(ids, pa.int64()),
         one(slugs, pa.string()), one(types, pa.string()), one(lens, pa.int32())], schema=_SCHEMA)


_SCHEMA = pa.schema([
    ("rng", pa.int64()), ("term", pa.string()), ("n", pa.int32()), ("max_f", pa.float64()), ("min_len", pa.int32()),
    ("slots", pa.list_(pa.int32())), ("f", pa.list_(pa.float64())), ("at", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())),
    ("slugs", pa.list_(pa.string())), ("types", pa.list_(pa.string())), ("lens", pa.list_(pa.int32()))])
_WEIGHT = np.array([FTS_WEIGHTS[f] for f in FTS_FIELDS])


def frequencies(at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, slot, weighted frequency) of every group's documents; ``at`` rises within a group."""
    slot = at >> (FIELD_BITS + PLACE_BITS)
    weight = _WEIGHT[(at >> PLACE_BITS) & ((1 << FIELD_BITS) - 1)]
    head = np.flatnonzero((np.diff(group, prepend=-1) != 0) | (np.diff(slot, prepend=-1) != 0))
    return group[head], slot[head], np.add.reduceat(weight, head) if len(head) else weight


def _blocks(rng: int, terms: pa.Array, at: np.ndarray, code: np.ndarray, lens: np.ndarray) -> pa.RecordBatch:
    """The blocks of a range; ``code`` numbers the term of each position, in order."""
    group, slot, f = frequencies(at, code)
    k = len(terms)
    edge = np.searchsorted(group, np.arange(k + 1)).astype(np.int32)
    cut = np.searchsorted(code, np.arange(k + 1)).astype(np.int32)
    lists = lambda edge, value, kind: pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(value, kind))
    most = np.maximum.reduceat(f, edge[:-1]) if k else f
    least = np.minimum.reduceat(lens[slot], edge[:-1]) if k else lens[:0]
    none = lambda kind: pa.nulls(k, kind)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(k, rng), pa.int64()), terms.cast(pa.string()), pa.array(np.diff(edge), pa.int32()), pa.array(most, pa.float64()),
         pa.array(least, pa.int32()), lists(edge, slot, pa.int32()), lists(edge, f, pa.float64()), lists(cut, at, pa.int64()),
         none(pa.list_(pa.int64())), none(pa.list_(pa.string())), none(pa.list_(pa.string())), none(pa.list_(pa.int32()))],
        schema=_SCHEMA)


def _build_range(rows: pa.Table) -> pa.Table:
    """Blocks and header of one range from ``rng, id, slug, type, toks`` (token lists by field)."""
    rows = rows.combine_chunks().sort_by("id")
    n, rng = rows.num_rows, rows.column("rng")[0].as_py()
    fields = rows.column("toks").combine_chunks()  # documents of fields of tokens
    fields = fields.chunk(0) if isinstance(fields, pa.ChunkedArray) else fields
    lists = fields.flatten()
    per_field = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    encoded = pc.dictionary_encode(lists.flatten())
    code = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    place = np.arange(len(code)) - np.repeat(np.cumsum(per_field) - per_field, per_field)
    where = np.repeat(np.arange(n * len(FTS_FIELDS)), per_field)
    slot, part = where // len(FTS_FIELDS), where % len(FTS_FIELDS)
    at = ((slot << FIELD_BITS | part) << PLACE_BITS) | place
    lens = per_field.reshape(n, len(FTS_FIELDS)).sum(axis=1)
    order = np.argsort(code, kind="stable")
    out = [_header(rng, *(rows.column(c).combine_chunks() for c in ("id", "slug", "type")), lens)]
    if len(code):
        out.append(_blocks(rng, encoded.dictionary, at[order], code[order], lens))
    return pa.Table.from_batches(out)


def blocks_of(concepts: DataFrame, first_range: int, ranges: int) -> DataFrame:
    """Blocks and headers of concepts dealt to ``ranges`` ranges from ``first_range`` on."""
    dealt = concepts.select(
        (F.pmod(F.xxhash64("id", F.lit(11)), F.lit(ranges)) + F.lit(first_range)).alias("rng"), "id", "slug", "type", *FTS_FIELDS)
    texts = [F.to_json(F.col(f)) if f == "tags" else F.coalesce(F.col(f), F.lit("")) for f in FTS_FIELDS]
    # Only tokens travel to the ranges.
    tokens = dealt.select("rng", "id", "slug", "type", F.array(*[fts_tokens(t) for t in texts]).alias("toks"))
    return tokens.groupBy("rng").applyInArrow(_build_range, BLOCK_DDL)


def _write_segment(blocks: DataFrame, path: str, ranges: int) -> None:
    stored = blocks.withColumn("tb", F.when(F.col("term").isNull(), F.lit(HEADER)).otherwise(term_bucket("term")))
    # A folder's blocks go to one file per ``FILE_RANGES`` ranges: a frequent term is spread over them.  A file is a
    # task by its number, not by its hash, so no task takes several.
    splits = -(-ranges // FILE_RANGES)
    file = (F.col("tb") - F.lit(HEADER)) * splits + F.pmod("rng", F.lit(splits))
    stored = stored.repartitionById((BUCKETS + 1) * splits, file.cast("int"))
    stored.sortWithinPartitions("tb", "term", "rng").write.partitionBy("tb").parquet(path)


# ---------------------------------------------------------------- the stored index

@dataclass
class SearchIndex:
    """A version of the stored index: its segments, tombstones and totals."""

    spark: SparkSession
    base: str
    segments: list[dict]
    dead: list[str] = field(default_factory=list)

    @property
    def n_docs(self) -> int:
        return sum(s["n_docs"] for s in self.segments)

    @property
    def n_tokens(self) -> int:
        return sum(s["n_tokens"] for s in self.segments)

    @property
    def n_ranges(self) -> int:
        return sum(s["n_ranges"] for s in self.segments)

    @property
    def avg_len(self) -> float:
        return self.n_tokens / self.n_docs if self.n_docs else 0.0

    def stored(self, segments: list[int] | None = None) -> DataFrame:
        """All rows of the live segments; ``tb`` and ``seg`` are folder columns."""
        paths = [s["path"] for s in self.segments if segments is None or s["seg"] in segments]
        reader = self.spark.read.schema(STORED_DDL)
        if not paths:
            return self.spark.createDataFrame([], STORED_DDL)
        return reader.option("basePath", f"{self.base}/blocks").parquet(*paths)

    def headers(self) -> DataFrame:
        return self.stored().where(F.col("tb") == HEADER)

    def blocks(self, buckets: list[int] | None = None) -> DataFrame:
        """Blocks of the given term folders (None: all)."""
        rows = self.stored()
        return rows.where(F.col("tb").isin(buckets) if buckets is not None else F.col("tb") != HEADER)

    def tombstones(self) -> DataFrame:
        """``seg, rng, slot, id`` of the dead documents of live segments."""
        live = [s["seg"] for s in self.segments]
        if not self.dead:
            return self.spark.createDataFrame([], "seg int, rng long, slot int, id long")
        return self.spark.read.parquet(*[f"{p}/slots" for p in self.dead]).where(F.col("seg").isin(live))

    def dead_terms(self) -> DataFrame:
        """``term, n``: dead documents of live segments by the terms that they held."""
        live = [s["seg"] for s in self.segments]
        if not self.dead:
            return self.spark.createDataFrame([], "term string, n long")
        rows = self.spark.read.parquet(*[f"{p}/terms" for p in self.dead]).where(F.col("seg").isin(live))
        return rows.groupBy("term").agg(F.sum("n").alias("n"))

    def live_headers(self) -> DataFrame:
        """Header rows with ``dead``, the slots that no longer count (null: none)."""
        dead = self.tombstones().groupBy("rng").agg(F.collect_list("slot").alias("dead"))  # at most a range's slots
        return self.headers().select("rng", "seg", "ids", "slugs", "types", "lens").join(dead, "rng", "left")

    def docs(self) -> DataFrame:
        """``id, slug, type, doc_len, seg, rng, slot`` of every live document."""
        h = self.live_headers()
        rows = h.select("rng", "seg", "dead", F.posexplode(F.arrays_zip("ids", "slugs", "types", "lens")).alias("slot", "d"))
        rows = rows.where(F.col("dead").isNull() | ~F.array_contains("dead", F.col("slot")))
        return rows.select(F.col("d.ids").alias("id"), F.col("d.slugs").alias("slug"), F.col("d.types").alias("type"),
                           F.col("d.lens").alias("doc_len"), "seg", "rng", "slot")

    def term_counts(self) -> DataFrame:
        """``term, n_docs, n_occ`` over live documents."""
        rows = self.blocks().select("rng", "term", F.explode("at").alias("at")).select(
            "rng", "term", F.shiftright("at", FIELD_BITS + PLACE_BITS).cast("int").alias("slot"))
        live = rows.join(self.tombstones().select("rng", "slot"), ["rng", "slot"], "left_anti")
        return live.groupBy("term", "rng", "slot").agg(F.count("*").alias("k")).groupBy("term").agg(
            F.count("*").alias("n_docs"), F.sum("k").alias("n_occ"))


def open_index(spark: SparkSession, base: str) -> SearchIndex:
    """The newest complete version under ``base``; an empty index if there is none."""
    base = base.rstrip("/")
    versions = snapshot.list_versions(spark, f"{base}/manifest")
    if not versions:
        return SearchIndex(spark, base, [])
    return _index_of(spark, base, versions[-1])


def _index_of(spark: SparkSession, base: str, version: str) -> SearchIndex:
    # A row per live segment or tombstone folder: a few per merge level.
    rows = spark.read.schema(MANIFEST_DDL).parquet(f"{base}/manifest/{version}").collect()
    segments = sorted((r.asDict() for r in rows if r.kind == "segment"), key=lambda s: s["seg"])
    for s in segments:
        s["path"] = f"{base}/blocks/{s['path']}"
    return SearchIndex(spark, base, segments, sorted(f"{base}/dead/{r.path}" for r in rows if r.kind == "dead"))


def _commit(index: SearchIndex, tag: str) -> SearchIndex:
    name = lambda p: p.rsplit("/", 1)[1]
    rows = [("segment", s["seg"], name(s["path"]), s["n_docs"], s["n_tokens"], s["n_ranges"]) for s in index.segments]
    rows += [("dead", None, name(p), None, None, None) for p in index.dead]
    manifest = index.spark.createDataFrame(rows, MANIFEST_DDL).coalesce(1)  # a few rows
    snapshot.write_snapshot(manifest, f"{index.base}/manifest", tag=tag)
    return open_index(index.spark, index.base)


def _add_segment(index: SearchIndex, seg: int, blocks: DataFrame, ranges: int) -> dict:
    name = f"seg={seg}"
    path = f"{index.base}/blocks/{name}"
    if snapshot.exists(index.spark, path):  # left by a run that ended before its manifest
        fs, jpath, _ = snapshot._fs(index.spark, path)
        fs.delete(jpath, True)
    _write_segment(blocks, path, ranges)
    rows = index.spark.read.schema(STORED_DDL).option("basePath", f"{index.base}/blocks").parquet(path).where(F.col("tb") == HEADER)
    total = rows.agg(F.sum("n").alias("n"), F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("t"),
                     F.count("*").alias("r")).first()
    return {"seg": seg, "path": path, "n_docs": total.n or 0, "n_tokens": total.t or 0, "n_ranges": total.r}


def _first_range(seg: int) -> int:
    return seg << 32


def build(concepts: DataFrame, base: str, range_docs: int = RANGE_DOCS, tag: str = "") -> SearchIndex:
    """A new index of all ``concepts`` as the next version under ``base``."""
    spark = concepts.sparkSession
    old = open_index(spark, base)
    seg = max([s["seg"] for s in old.segments], default=0) + 1
    index = SearchIndex(spark, base.rstrip("/"), [])
    n = concepts.count()
    if n:
        ranges = -(-n // range_docs)
        index.segments.append(_add_segment(index, seg, blocks_of(concepts, _first_range(seg), ranges), ranges))
    return _commit(index, tag)


def refresh(base: str, gone: DataFrame, fresh: DataFrame, range_docs: int = RANGE_DOCS, fan: int = FAN, tag: str = "") -> SearchIndex:
    """The next version: without the documents of ``gone`` and with those of ``fresh``.

    ``gone``: concept rows as they were indexed (changed and removed ones); ``fresh``: the new and
    changed rows.  ``tag`` names the run; the version of a run that is repeated is returned as it is.
    """
    spark = gone.sparkSession
    base = base.rstrip("/")
    if tag:
        for v in snapshot.list_versions(spark, f"{base}/manifest"):
            if snapshot.tag_of(v) == tag:
                return _index_of(spark, base, v)
    index = open_index(spark, base)
    segments, dead = [dict(s) for s in index.segments], list(index.dead)
    # Numbers are never used again, so tombstones of merged segments fall out by their number.
    top = max([s["seg"] for s in segments], default=0)
    gone = materialize(gone.select("id", *FTS_FIELDS), "index-gone")
    if not gone.isEmpty():
        name = uuid.uuid4().hex[:12]
        path = f"{base}/dead/{name}"
        slots = index.docs().join(gone.select("id").distinct(), "id", "left_semi")
        slots.select("seg", "rng", "slot", "id", "doc_len").write.parquet(f"{path}/slots")
        marked = spark.read.parquet(f"{path}/slots")
        terms = fts._postings_of(gone.join(marked.select("id"), "id", "left_semi")).select("id", "term").distinct()
        terms.join(marked.select("id", "seg"), "id").groupBy("seg", "term").agg(F.count("*").alias("n")).write.parquet(f"{path}/terms")
        dead.append(path)
        lost = {r.seg: r for r in marked.groupBy("seg").agg(F.count("*").alias("n"), F.sum("doc_len").alias("t")).collect()}
        for s in segments:
            if s["seg"] in lost:
                s["n_docs"] -= lost[s["seg"]].n
                s["n_tokens"] -= lost[s["seg"]].t
    n = fresh.count()
    now = SearchIndex(spark, base, segments, dead)
    if n:
        ranges = -(-n // range_docs)
        now.segments.append(_add_segment(now, top + 1, blocks_of(fresh, _first_range(top + 1), ranges), ranges))
    return _commit(_merged(now, range_docs, fan, top + 2), tag)


# ---------------------------------------------------------------- merging

def _tier(n_docs: int, range_docs: int, fan: int) -> int:
    tier = 0
    while n_docs > range_docs * fan**tier:
        tier += 1
    return tier


def _merged(index: SearchIndex, range_docs: int, fan: int, seg: int) -> SearchIndex:
    """The index after merging, smallest first, every tier that has ``fan`` segments."""
    segments = list(index.segments)
    while True:
        tiers: dict[int, list[dict]] = {}
        for s in segments:
            tiers.setdefault(_tier(s["n_docs"], range_docs, fan), []).append(s)
        full = next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= fan), None)
        now = SearchIndex(index.spark, index.base, segments, index.dead)
        if full is None:
            break
        segments = [s for s in segments if s not in full]
        live = sum(s["n_docs"] for s in full)
        if live:
            blocks, ranges = _merge(now, [s["seg"] for s in full], seg, range_docs)
            segments.append(_add_segment(now, seg, blocks, ranges))
            seg += 1
    live = [s["seg"] for s in now.segments]
    if now.dead:  # tombstone folders that concern live segments
        spark = now.spark
        now.dead = [p for p in now.dead if not spark.read.parquet(f"{p}/slots").where(F.col("seg").isin(live)).isEmpty()]
    return now


def _merge(index: SearchIndex, segs: list[int], seg: int, range_docs: int) -> tuple[DataFrame, int]:
    """(blocks of segment ``seg``, ranges): the ranges of ``segs`` joined to ranges of about ``range_docs`` live documents."""
    rows = index.stored(segs)
    dead = index.tombstones().groupBy("rng").agg(F.collect_list("slot").alias("dead"))
    heads = rows.where(F.col("tb") == HEADER).select("rng", F.size("ids").alias("n")).join(dead, "rng", "left")
    heads = heads.withColumn("live", F.col("n") - F.coalesce(F.size("dead"), F.lit(0)))
    # A row per range; sums within parts of 4,096 ranges, then over the parts.
    part = F.floor(F.xxhash64("rng") / (1 << 51))
    inside = Window.partitionBy("part").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("part", part)
    before = heads.groupBy("part").agg(F.sum("live").alias("t"))
    before = before.withColumn("shift", F.coalesce(F.sum("t").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    heads = heads.withColumn("own", F.coalesce(F.sum("live").over(inside), F.lit(0))).join(before.select("part", "shift"), "part")
    goal = (F.floor((F.col("own") + F.col("shift")) / range_docs) + F.lit(_first_range(seg))).cast("long").alias("goal")
    goals = materialize(heads.select("rng", goal, "dead"), "index-goals")
    ranges = goals.select("goal").distinct().count()
    moved = rows.drop("seg", "tb").join(goals, "rng")
    return moved.groupBy("goal").applyInArrow(_merge_ranges, BLOCK_DDL), ranges


def _merge_ranges(rows: pa.Table) -> pa.Table:
    """One range from the rows of several old ones (``goal``, ``dead``)."""
    rows = rows.combine_chunks()
    goal = rows.column("goal")[0].as_py()
    old = rows.column("rng").to_numpy()
    head = rows.filter(pc.is_null(rows.column("term")))
    start, slot_of, docs = 0, {}, {c: [] for c in ("ids", "slugs", "types", "lens")}
    for r in sorted(head.to_pylist(), key=lambda r: r["rng"]):
        gone = set(r["dead"] or ())
        stay = [i for i in range(len(r["ids"])) if i not in gone]
        to = np.full(len(r["ids"]), -1, np.int64)
        to[stay] = start + np.arange(len(stay))
        slot_of[r["rng"]] = to
        start += len(stay)
        for c, values in docs.items():
            values += [r[c][i] for i in stay]
    lens = np.array(docs["lens"], np.int64)
    out = [_header(goal, docs["ids"], docs["slugs"], docs["types"], lens)]
    some = pc.is_valid(rows.column("term"))
    keep = np.flatnonzero(some.to_numpy())
    if len(keep):
        body = rows.take(pa.array(keep))
        lists = body.column("at").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        at = lists.flatten().to_numpy()
        terms = body.column("term").combine_chunks()
        encoded = pc.dictionary_encode(terms.chunk(0) if isinstance(terms, pa.ChunkedArray) else terms)
        code = np.repeat(encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), size)
        bits = FIELD_BITS + PLACE_BITS
        new = np.empty(len(at), np.int64)
        row_rng = np.repeat(old[keep], size)
        for r, to in slot_of.items():
            mine = row_rng == r
            new[mine] = to[at[mine] >> bits]
        stay = new >= 0
        at = (new[stay] << bits) | (at[stay] & ((1 << bits) - 1))
        code = code[stay]
        order = np.lexsort((at, code))
        at, code = at[order], code[order]
        used, code = np.unique(code, return_inverse=True)
        if len(used):
            out.append(_blocks(goal, encoded.dictionary.take(pa.array(used)), at, code, lens))
    return pa.Table.from_batches(out)


# ---------------------------------------------------------------- search

UNIT_DDL = "rng long, pkey string, n int, max_f double, min_len int, slots array<int>, f array<double>"


def _phrase_units(rows: pa.Table, wanted: pa.Table) -> pa.Table:
    """Blocks of phrases of several tokens in one range, from its tokens' blocks and header.

    ``wanted``: ``pkey, toks`` of phrases whose tokens may meet in the range.
    """
    schema = pa.schema([("rng", pa.int64()), ("pkey", pa.string()), ("n", pa.int32()), ("max_f", pa.float64()), ("min_len", pa.int32()),
                        ("slots", pa.list_(pa.int32())), ("f", pa.list_(pa.float64()))])
    place, lens, gone = {}, None, ()
    for r in rows.to_pylist():
        if r["term"] is None:
            lens, gone = np.array(r["lens"], np.int64), r["dead"] or ()
        else:
            place[r["term"]] = np.array(r["at"], np.int64)
    out = []
    for pkey, toks in zip(wanted.column("pkey").to_pylist(), wanted.column("toks").to_pylist()):
        if lens is None or any(t not in place for t in toks):
            continue
        start = place[toks[0]]
        for j, t in enumerate(toks[1:], 1):
            start = start[np.isin(start + j, place[t], assume_unique=True)]
        # a place in the last field's end never runs into the next field: places are far below 2**32
        _, slot, f = frequencies(start, np.zeros(len(start), np.int64))
        live = ~np.isin(slot, gone)
        slot, f = slot[live], f[live]
        if len(slot):
            rng = rows.column("rng")[0].as_py()
            out.append((rng, pkey, len(slot), float(f.max()), int(lens[slot].min()), slot.tolist(), f.tolist()))
    return pa.Table.from_pylist([dict(zip(schema.names, r)) for r in out], schema) if out else schema.empty_table()


def _score_range(avg_len: float):
    """Scores of the queries that ask for one range."""
    kinds = {"query_id": pa.int64(), "id": pa.int64(), "slug": pa.string(), "type": pa.string(), "rank": pa.float64()}
    schema = pa.schema(list(kinds.items()))

    def run(rows: pa.Table, asks: pa.Table) -> pa.Table:
        head = rows.filter(pc.is_null(rows.column("pkey")))
        body = rows.filter(pc.is_valid(rows.column("pkey")))
        if not head.num_rows or not body.num_rows or not asks.num_rows:
            return schema.empty_table()
        head = head.slice(0, 1).to_pylist()[0]
        lens = np.array(head["lens"], float)
        size = len(lens)
        alive = np.ones(size, bool)
        alive[head["dead"] or []] = False
        types = np.array([t or "" for t in head["types"]], object)
        # the units' documents one after the other
        lists = body.column("slots").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        slots = lists.flatten().to_numpy().astype(np.int64)
        freq = body.column("f").combine_chunks()
        freq = (freq.chunk(0) if isinstance(freq, pa.ChunkedArray) else freq).flatten().to_numpy()
        norm = BM25_K1 * (1 - BM25_B + BM25_B * lens / avg_len) if avg_len else np.full(size, BM25_K1)
        value = freq / (freq + norm[slots])
        first = np.cumsum(n) - n
        unit = {p: i for i, p in enumerate(body.column("pkey").to_pylist())}
        found = []
        queries = asks.select(["query_id", "k", "theta", "types", "pkeys", "weights"]).to_pylist()
        for part in _bounded(queries, unit, n):
            owner = np.array([q for q, r in enumerate(part) for p in r["pkeys"] if p in unit], np.int64)
            units = np.array([unit[p] for r in part for p in r["pkeys"] if p in unit], np.int64)
            weight = np.array([w for r in part for p, w in zip(r["pkeys"], r["weights"]) if p in unit])
            count = n[units]
            row = np.repeat(np.arange(len(units)), count)
            pick = first[units][row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            cell = owner[row] * size + slots[pick]
            score = np.bincount(cell, weight[row] * value[pick], minlength=len(part) * size).reshape(len(part), size)
            hit = np.bincount(cell, minlength=len(part) * size).reshape(len(part), size) > 0
            hit &= alive[None, :]
            for q, r in enumerate(part):
                ok = hit[q]
                if r["types"]:
                    ok = ok & np.isin(types, r["types"])
                doc = np.flatnonzero(ok)
                own = score[q, doc]
                least = -np.inf if r["theta"] is None else r["theta"] - 1e-8
                if len(doc) > r["k"]:  # ties at the cut stay; the cut over all ranges follows
                    least = max(least, np.partition(own, len(own) - r["k"])[len(own) - r["k"]] - 1e-8)
                doc = doc[own >= least]
                found.append((np.full(len(doc), r["query_id"], np.int64), doc, score[q, doc]))
        if not found:
            return schema.empty_table()
        take = np.concatenate([d for _, d, _ in found])
        ids, slugs = np.array(head["ids"], np.int64), np.array(head["slugs"], object)
        return pa.Table.from_arrays([
            pa.array(np.concatenate([q for q, _, _ in found])), pa.array(ids[take]), pa.array(slugs[take], pa.string()),
            pa.array(np.array(head["types"], object)[take], pa.string()), pa.array(-np.concatenate([s for _, _, s in found]))], schema=schema)

    return run


def _bounded(queries: list[dict], unit: dict, n: np.ndarray, most: int = 1 << 18) -> Iterator[list[dict]]:
    """Queries in parts whose documents, counted per phrase, stay near ``most``."""
    part, load = [], 0
    for r in queries:
        own = sum(int(n[unit[p]]) for p in r["pkeys"] if p in unit)
        if part and (load + own > most or len(part) >= 512):
            yield part
            part, load = [], 0
        part.append(r)
        load += own
    if part:
        yield part


def top_documents(index: SearchIndex, queries: DataFrame, k_max: int | None = None, broadcast: bool | None = None,
                  direct: int = DIRECT_RANGES, probe: int = PROBE) -> DataFrame:
    """``query_id, id, slug, type, rank, fts_pos`` of every query's best ``cand`` documents.

    ``queries(query_id, query, cand, types)``.  Lowest rank first, ties (to nine decimals) by slug.
    """
    small = lambda df: fts._small(df, broadcast)
    phrases = fts.query_phrases(queries.select("query_id", "query"))
    phrases = materialize(phrases.groupBy("query_id", "pkey").agg(F.first("toks").alias("toks"), F.count("*").alias("times")), "phrases")
    keys = phrases.groupBy("pkey").agg(F.first("toks").alias("toks"))
    terms = keys.select(F.explode("toks").alias("term")).distinct()
    # At most ``BUCKETS`` numbers: they prune the index's folders as literals.
    buckets = sorted(r.tb for r in terms.select(term_bucket("term").alias("tb")).distinct().collect())
    blocks = index.blocks(buckets)
    single = keys.where(F.size("toks") == 1).select("pkey", F.get("toks", F.lit(0)).alias("term"))
    units = blocks.join(small(single), "term").select("rng", "pkey", "term", "n", "max_f", "min_len", "slots", "f")
    dead = index.dead_terms().select("term", F.col("n").alias("gone"))
    seen = units.select("pkey", "term", "n").groupBy("pkey", "term").agg(F.sum("n").alias("n")).join(dead, "term", "left").select(
        "pkey", (F.col("n") - F.coalesce("gone", F.lit(0))).alias("n"))
    units = units.drop("term")

    many = keys.where(F.size("toks") > 1)
    if not many.isEmpty():
        found = materialize(_phrases(index, blocks, many, small), "phrase-units")
        seen = seen.unionByName(found.groupBy("pkey").agg(F.sum("n").alias("n")))
        units = units.unionByName(found)
    n_docs, avg_len = index.n_docs, index.avg_len
    raw = F.log((F.lit(float(n_docs)) - F.col("n") + 0.5) / (F.col("n") + 0.5))
    # The factors of a batch's phrases: as many rows as it has phrases.
    idf = seen.where("n > 0").select("pkey", (F.when(raw <= 0, F.lit(BM25_MIN_IDF)).otherwise(raw) * (BM25_K1 + 1)).alias("w"))
    asked = phrases.select("query_id", "pkey", "times").join(idf, "pkey").select("query_id", "pkey", (F.col("times") * F.col("w")).alias("w"))
    longest = F.col("max_f") / (F.col("max_f") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("min_len") / F.lit(avg_len or 1.0)))
    best = F.when(F.col("max_f") > 0, longest).otherwise(F.lit(0.0))
    asks = units.select("rng", "pkey", best.alias("best")).join(small(asked), "pkey").groupBy("rng", "query_id").agg(
        F.sum(F.col("w") * F.col("best")).alias("most"), F.collect_list("pkey").alias("pkeys"), F.collect_list("w").alias("weights"))
    cuts = queries.select("query_id", F.col("cand").cast("int").alias("k"), "types")
    asks = asks.join(small(cuts), "query_id")
    heads = index.live_headers()
    none = F.lit(None)
    heads = heads.select("rng", none.cast("string").alias("pkey"), none.cast("array<int>").alias("slots"), none.cast("array<double>").alias("f"),
                         "types", "lens", "ids", "slugs", "dead")
    rows = units.select("rng", "pkey", "slots", "f").unionByName(heads, allowMissingColumns=True)
    out_ddl = "query_id long, id long, slug string, type string, rank double"

    if index.n_ranges <= direct:
        # columns of their own, as both sides come from the same blocks
        apart = asks.select(F.col("rng").alias("ask"), "query_id", "pkeys", "weights", "k", "types", F.lit(None).cast("double").alias("theta"))
        ranked = rows.groupBy("rng").cogroup(apart.groupBy("ask")).applyInArrow(_score_range(avg_len), out_ddl)
    else:
        asks = materialize(asks, "asks")
        by_hope = Window.partitionBy("query_id").orderBy(F.desc("most"), "rng")
        tried = asks.withColumn("pos", F.row_number().over(by_hope)).where(F.col("pos") <= probe).drop("pos")
        first = materialize(_only(rows, tried.withColumn("theta", F.lit(None).cast("double")), avg_len, out_ddl), "probe")
        place = Window.partitionBy("query_id").orderBy(F.asc("rank"))
        limit = first.withColumn("pos", F.row_number().over(place)).join(small(cuts.select("query_id", "k")), "query_id")
        limit = limit.where("pos = k").select("query_id", (-F.col("rank")).alias("theta"))
        left = asks.join(tried.select("rng", "query_id"), ["rng", "query_id"], "left_anti").join(small(limit), "query_id", "left")
        left = left.where(F.col("theta").isNull() | (F.col("most") >= F.col("theta") - 1e-8))
        ranked = first.unionByName(_only(rows, left, avg_len, out_ddl))
    ranked = ranked.join(small(queries.select("query_id", "cand")), "query_id")
    return fts.top_by_rank(ranked, "cand", k_max=k_max).drop("cand")


def _only(rows: DataFrame, part: DataFrame, avg_len: float, ddl: str) -> DataFrame:
    """Scores of ``part``; only the blocks that it asks for are moved to their ranges."""
    part = materialize(part, "asked")
    need = part.select("rng", F.explode("pkeys").alias("pkey")).distinct()
    ranges = part.select("rng").distinct()
    body = rows.where("pkey is not null").join(need, ["rng", "pkey"], "left_semi")
    heads = rows.where("pkey is null").join(ranges, "rng", "left_semi")
    return body.unionByName(heads).groupBy("rng").cogroup(part.groupBy("rng")).applyInArrow(_score_range(avg_len), ddl)


def _phrases(index: SearchIndex, blocks: DataFrame, many: DataFrame, small) -> DataFrame:
    """Blocks of the phrases ``many(pkey, toks)``, found where all their tokens have a block."""
    tokens = many.select("pkey", F.explode(F.array_distinct("toks")).alias("term"), F.size(F.array_distinct("toks")).alias("need"))
    met = blocks.select("rng", "term").join(small(tokens), "term").groupBy("rng", "pkey", "need").agg(F.count("*").alias("have"))
    wanted = met.where("have = need").select("rng", "pkey").join(small(many), "pkey")
    wanted = materialize(wanted.select("rng", "pkey", "toks"), "phrase-ranges")
    needed = wanted.select("rng", F.explode("toks").alias("term")).distinct()
    body = blocks.select("rng", "term", "at").join(needed, ["rng", "term"], "left_semi")
    heads = index.live_headers().select("rng", F.lit(None).cast("string").alias("term"), F.lit(None).cast("array<long>").alias("at"),
                                        "lens", "dead").join(wanted.select("rng").distinct(), "rng", "left_semi")
    rows = body.unionByName(heads, allowMissingColumns=True)
    return rows.groupBy("rng").cogroup(wanted.groupBy("rng")).applyInArrow(_phrase_units, UNIT_DDL)
