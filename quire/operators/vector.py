"""Vector side: exact cosine KNN (V3) with distance normalisation (V4).

A query batch of up to ``MAX_QUERY_CHUNK`` vectors is broadcast as a numpy matrix; every
partition of the corpus computes its distances with matrix products, keeps a running
top-k per query (ties at the cut kept) and emits it once.  A window limit takes the global top-k.

A larger query table never passes through the driver.  Corpus and queries are both partitioned by
*pivots*, corpus vectors that stand for cells: a vector belongs to the cell of its nearest pivot, and a cell knows
the largest distance of a member to its pivot.  A query first searches the nearest cells that hold enough
vectors; its k-th distance there bounds what is left: by the triangle inequality a cell farther than that bound plus the cell's radius, and in a cell a vector
whose distance to the pivot differs from the query's by more, can't hold a neighbour.  Cells are put into groups, and groups meet parts of the
query table, both of bounded size: a row is moved once per group or part, not once per cell, and a task keeps a running top-k.
On vectors without clusters in many dimensions, no bound prunes, and the search compares all pairs, in bounded blocks: single-precision
products pick what may be near enough, with room for their rounding, and only that is measured in double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import materialize, ship_package

# Queries per broadcast chunk (x dims x 4 bytes: 256 dims -> ~4 MB per 4096).
MAX_QUERY_CHUNK = 4096
TIE_EPS = 1e-12


def _cand_schema(key_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", T.LongType()),
            T.StructField("id", T.LongType()),
            T.StructField("_key", key_type),
            T.StructField("distance", T.DoubleType()),
        ]
    )


# Rows of an Arrow batch and queries scored together: bounds the distance matrix
# to SCAN_ROWS x QUERY_BLOCK doubles (about 8 MB), however many rows a batch has.
QUERY_BLOCK = 512
SCAN_ROWS = 2048


def _block_topk(emb, norms, valid, types, qv, qn, ks, qtypes_cols, least):
    """Distances of one row block to one query block, and the kept cells: none beyond ``least``, a distance per query."""
    sims = (emb @ qv.T) / np.where(valid, norms, 1.0)[:, None] / qn[None, :]
    dist = 1.0 - sims
    dist[~valid, :] = np.inf
    dist[np.isnan(dist)] = np.inf
    for allowed, cols in qtypes_cols:
        dist[np.ix_(~np.isin(types, list(allowed)), cols)] = np.inf
    n = dist.shape[0]
    kk = np.minimum(ks, n)
    top = min(int(kk.max()), n)
    part = np.partition(dist, top - 1, axis=0)[:top] if top < n else dist.copy()
    part.sort(axis=0)
    thr = np.minimum(part[kk - 1, np.arange(len(ks))], least)
    mask = np.isfinite(dist) & (dist <= thr[None, :] + TIE_EPS)
    rows, cols = np.nonzero(mask)
    return rows, cols, dist[rows, cols]


class _Best:
    """The running top-k of every query of a batch: cells kept so far, cut down now and then.

    ``least``: the distance of every query beyond which nothing is wanted any more, as of the last cut.
    """

    def __init__(self, ks: np.ndarray, most: int = 1 << 18):
        self.ks, self.most, self.held, self.n = ks, most, [], 0
        self.least = np.full(len(ks), np.inf)

    def add(self, query: np.ndarray, ids: np.ndarray, keys: np.ndarray, distance: np.ndarray) -> None:
        self.held.append((query, ids, keys, distance))
        self.n += len(query)
        if self.n > self.most:
            self.held = [self.cut()]
            self.n = len(self.held[0][0])
            self.most = max(self.most, 2 * self.n)

    def cut(self) -> tuple:
        query, ids, keys, distance = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((distance, query))
        query, distance = query[order], distance[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        first = np.searchsorted(query, np.arange(len(self.ks)))
        count = np.bincount(query, minlength=len(self.ks))
        last = np.minimum(first + np.minimum(self.ks, count) - 1, len(query) - 1)
        full = count >= self.ks
        self.least[full] = distance[last[full]]
        keep = (rank < self.ks[query]) | (distance <= distance[last][query] + TIE_EPS)
        return query[keep], ids[order][keep], keys[order][keep], distance[keep]


def _partition_topk(bq):
    def run(batches):
        q = bq.value
        qv, qn, qids, ks, qtypes = q["vecs"], q["norms"], q["ids"], q["k"], q["types"]
        best = _Best(ks)
        for pdf in (batch.iloc[at : at + SCAN_ROWS] for batch in batches for at in range(0, len(batch), SCAN_ROWS)):
            emb = np.stack([np.asarray(e, dtype=np.float64) for e in pdf["embedding"].values])
            norms = np.sqrt((emb * emb).sum(axis=1))
            valid = norms > 0
            types = pdf["type"].values if qtypes is not None else None
            ids, keys = pdf["id"].values, pdf["_key"].values
            for start in range(0, len(qids), QUERY_BLOCK):
                sl = slice(start, start + QUERY_BLOCK)
                groups = []
                if qtypes is not None:
                    for allowed, cols in qtypes.items():
                        local = cols[(cols >= start) & (cols < start + QUERY_BLOCK)] - start
                        if len(local):
                            groups.append((allowed, local))
                rows, cols, d = _block_topk(emb, norms, valid, types, qv[sl], qn[sl], ks[sl], groups, best.least[sl])
                best.add(start + cols, ids[rows], keys[rows], d)
        if best.n:
            query, ids, keys, d = best.cut()
            for at in range(0, len(query), 100_000):
                part = slice(at, at + 100_000)
                yield pd.DataFrame({"query_id": qids[query[part]].astype(np.int64), "id": ids[part].astype(np.int64),
                                    "_key": keys[part], "distance": d[part]})

    return run


def knn(corpus: DataFrame, queries: DataFrame, k_col: str = "k", types_col: str | None = None,
        id_col: str = "id", key_col: str = "slug", k_max: int | None = None, partitioned: bool | None = None,
        cell_rows: int = 4096, max_cells: int = 1024) -> DataFrame:
    """Exact cosine KNN for a batch of query vectors.

    corpus: ``(id, <key_col>, embedding[, type])``; queries: ``(query_id,
    qvec, k[, types])``.  Returns ``(query_id, id, distance, vec_pos)`` with
    vec_pos 1..k by distance then ``key_col``.  Zero vectors on either side
    are left out (cosine undefined).  ``partitioned`` (else: where the query table is larger than
    one broadcast) searches by pivots.
    """
    spark = corpus.sparkSession
    ship_package(spark)
    key_type = corpus.schema[key_col].dataType
    cols = [F.col(id_col).alias("id"), F.col(key_col).alias("_key"), F.col("embedding")]
    if types_col:
        cols.append(F.col("type"))
    body = corpus.select(*cols)
    qcols = ["query_id", "qvec", F.col(k_col).alias("k")] + ([F.col(types_col).alias("types")] if types_col else [])
    q = queries.select(*qcols).where("qvec is not null")
    rows = q.limit(MAX_QUERY_CHUNK + 1).collect() if partitioned is None or not partitioned else []
    if partitioned is None:
        partitioned = len(rows) > MAX_QUERY_CHUNK
    if partitioned:
        cand = _by_pivots(body, q, key_type, cell_rows, max_cells, bool(types_col))
        kq = q.select("query_id", F.greatest("k", F.lit(1)).alias("_k"))
    else:
        chunk = _pack(rows, "k", "types" if types_col else None) if rows else None
        if chunk is None or not len(chunk["ids"]):
            return spark.createDataFrame([], "query_id long, id long, distance double, vec_pos int")
        top_k = int(chunk["k"].max())
        k_max = top_k if k_max is None else max(k_max, top_k)
        cand = body.mapInPandas(_partition_topk(spark.sparkContext.broadcast(chunk)), _cand_schema(key_type))
        kq = F.broadcast(q.select("query_id", F.col("k").alias("_k")))  # at most MAX_QUERY_CHUNK rows
    # The key travels with each candidate: no join back to the corpus.
    w = Window.partitionBy("query_id").orderBy(F.round("distance", 12), F.col("_key"))
    ranked = cand.withColumn("vec_pos", F.row_number().over(w))
    if k_max is not None:  # literal bound: partial top-k before the shuffle
        ranked = ranked.where(F.col("vec_pos") <= F.lit(int(k_max)))
    ranked = ranked.join(kq, on="query_id")
    return ranked.where(F.col("vec_pos") <= F.col("_k")).select("query_id", "id", "distance", "vec_pos")


# ---------------------------------------------------------------- pivots

# Room for the rounding of distances: that of a vector to itself may come out near 3e-8.
_SLACK = 1e-7
GROUP_CELLS = 16  # cells of ``cell_rows`` vectors that a task takes at most
ROW_BLOCK = 4096  # vectors whose products with a block of queries are held at a time


def _units(vectors) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, which rows are not zero)."""
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    norm = np.sqrt((x * x).sum(axis=1))
    return x / np.where(norm > 0, norm, 1.0)[:, None], norm > 0


def _gaps(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of unit vectors to pivots; half their square is the cosine distance."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (x @ pivots.T), 0.0))


def reachable(gap: np.ndarray, radius: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Which cells may hold a vector within ``bound`` (a distance) of each query: queries x cells."""
    return gap - radius[None, :] <= bound[:, None] + _SLACK


def _groups(size: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(first group, number of groups) of every cell: small cells share a group of about ``rows`` vectors, a large one is cut."""
    start, parts = np.zeros(len(size), np.int64), np.maximum(1, -(-size // rows))
    group, held = 0, 0
    for c, n in enumerate(size):
        if held and held + n > rows:
            group, held = group + 1, 0
        start[c], held = group, held + n
        if parts[c] > 1:
            group, held = group + parts[c], 0
    return start, parts


def _nearest(x: np.ndarray, q: np.ndarray, ks: np.ndarray, least: np.ndarray, allowed=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, query, distance) of vectors ``x`` that may be among the ``ks`` nearest of unit vectors ``q``.

    ``least``: a distance per query beyond which nothing is asked for.  Products in single precision pick the vectors that
    are near enough, with room for their rounding; their distances are then taken in double precision.
    """
    x32, q32 = x.astype(np.float32), q.astype(np.float32)
    room = (x.shape[1] + 8) * 2.0**-22
    held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
    for at in range(0, len(x), ROW_BLOCK):
        sims = q32 @ x32[at : at + ROW_BLOCK].T
        for cols, ok in allowed or ():
            sims[np.ix_(cols, ~ok[at : at + ROW_BLOCK])] = -np.inf
        floor = 1.0 - least - room - TIE_EPS
        loose = np.flatnonzero(np.isinf(floor))
        if len(loose):  # no distance known yet: the k-th of this block
            k = np.minimum(ks[loose], sims.shape[1])
            top = np.partition(sims[loose], sims.shape[1] - np.unique(k), axis=1)
            floor[loose] = top[np.arange(len(loose)), sims.shape[1] - k] - 2 * room - TIE_EPS
        floor = np.nextafter(np.maximum(floor, -4.0).astype(np.float32), np.float32(-np.inf))
        query, row = np.divmod(np.flatnonzero(sims >= floor[:, None]), sims.shape[1])
        if not len(query):
            continue
        row += at
        far = np.empty(len(row))
        for i in range(0, len(row), 1 << 16):
            part = slice(i, i + (1 << 16))
            far[part] = 1.0 - np.einsum("ij,ij->i", x[row[part]], q[query[part]])
        keep = far <= least[query] + TIE_EPS
        row, query, far = (np.concatenate([h, v[keep]]) for h, v in zip(held, (row, query, far)))
        order = np.lexsort((far, query))
        row, query, far = row[order], query[order], far[order]
        count = np.bincount(query, minlength=len(q))
        first = np.cumsum(count) - count
        full = np.flatnonzero(count >= ks)
        least = least.copy()
        least[full] = np.minimum(least[full], far[first[full] + ks[full] - 1])
        near = far <= least[query] + TIE_EPS
        held = [row[near], query[near], far[near]]
    return tuple(held)


def _by_pivots(body: DataFrame, q: DataFrame, key_type: T.DataType, cell_rows: int, max_cells: int, typed: bool) -> DataFrame:
    """Candidates ``query_id, id, _key, distance``, the nearest k of every query among them."""
    n = body.count()
    cells = int(min(max_cells, max(1, n // cell_rows)))
    # a bounded, deterministic choice: the vectors whose ids hash lowest
    some = body.where(F.exists("embedding", lambda v: v != 0)).orderBy(F.xxhash64("id"), "id").limit(cells).collect()
    spark = body.sparkSession
    empty = spark.createDataFrame([], _cand_schema(key_type))
    if not some:
        return empty
    pivots, _ = _units([r["embedding"] for r in some])

    def assign(batches):
        for pdf in batches:
            x, known = _units(pdf["embedding"]) if len(pdf) else (np.empty((0, 1)), np.empty(0, bool))
            if not known.any():
                continue
            gap = _gaps(x[known], pivots)
            pdf = pdf[known].assign(cell=gap.argmin(axis=1).astype(np.int32), gap=gap.min(axis=1))
            yield pdf

    names = body.columns
    fields = [*body.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("gap", T.DoubleType())]
    placed = materialize(body.mapInPandas(assign, T.StructType(fields)).select(*names, "cell", "gap"), "knn-cells")
    # a row per cell
    stats = {r.cell: r for r in placed.groupBy("cell").agg(F.max("gap").alias("radius"), F.count("*").alias("n")).collect()}
    radius = np.array([stats[c].radius if c in stats else -np.inf for c in range(len(pivots))])
    size = np.array([stats[c].n if c in stats else 0 for c in range(len(pivots))])
    # Groups of cells meet parts of the queries: a row is moved once per group or part that it meets, not once per cell,
    # and neither side of a task grows with its table.
    n_asks = q.count()
    side = (n * n_asks / (4 * spark.sparkContext.defaultParallelism)) ** 0.5
    side = int(min(max(side, cell_rows), GROUP_CELLS * cell_rows))
    start, parts = _groups(size, side)
    ask_parts = max(1, -(-n_asks // side))
    of_cell = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("cell") + 1)
    placed = placed.withColumn("group", (of_cell(start) + F.pmod(F.xxhash64("id", F.lit(5)), of_cell(parts))).cast("int"))
    dealt = q.withColumn("part", F.pmod(F.xxhash64("query_id", F.lit(7)), F.lit(ask_parts)).cast("int"))

    def wanted(x, asks):
        """(queries x cells to search, largest distance asked for); without ``theta`` the nearest cells that hold k vectors."""
        gap = _gaps(x, pivots)
        if "theta" in asks:
            theta = asks["theta"].to_numpy(float)
            theta = np.where(np.isnan(theta), np.inf, theta)
            # room for ties, and for copies, whose distance may round below 0
            take = reachable(gap, radius, np.sqrt(2 * np.maximum(theta, 0.0) + 4 * TIE_EPS))
        else:
            theta, take = np.full(len(asks), np.inf), np.zeros(gap.shape, bool)
            near = np.argsort(gap, axis=1, kind="stable")
            before = np.cumsum(size[near], axis=1) - size[near]
            np.put_along_axis(take, near, before < np.maximum(asks["k"].to_numpy(), 1)[:, None], axis=1)
        return take & (size > 0)[None, :], theta, gap

    def ask(batches):
        """A row per query and group that holds a cell to search."""
        for pdf in batches:
            if not len(pdf):
                continue
            x, known = _units(pdf["qvec"])
            pdf, x = pdf[known], x[known]
            for at in range(0, len(pdf), QUERY_BLOCK):
                part = pdf.iloc[at : at + QUERY_BLOCK]
                take, _, _ = wanted(x[at : at + QUERY_BLOCK], part)
                row, cell = np.nonzero(take)
                many = parts[cell]
                row, first = np.repeat(row, many), np.repeat(start[cell], many)
                group = first + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                row, group = np.unique(np.stack([row, group]), axis=1)
                yield part.iloc[row].assign(group=group.astype(np.int32))

    def search(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.empty(0, np.int64), "id": np.empty(0, np.int64), "_key": rows["_key"].iloc[:0], "distance": np.empty(0)})
        if not len(rows) or not len(asks):
            return none
        rows = rows.sort_values(["cell", "gap"])
        emb, _ = _units(rows["embedding"])
        cell, gap = rows["cell"].to_numpy(), rows["gap"].to_numpy()
        here, first = np.unique(cell, return_index=True)
        last = np.append(first[1:], len(cell))
        vecs, _ = _units(asks["qvec"])
        # queries of a block should want the same cells
        order = np.argsort(_gaps(vecs, pivots[here]).argmin(axis=1), kind="stable")
        asks, vecs, out = asks.iloc[order], vecs[order], []
        for at in range(0, len(asks), QUERY_BLOCK):
            part, x = asks.iloc[at : at + QUERY_BLOCK], vecs[at : at + QUERY_BLOCK]
            take, least, own = wanted(x, part)
            chord = np.sqrt(2 * np.maximum(least, 0.0) + 4 * TIE_EPS)
            pick = []
            for c, lo, hi in zip(here, first, last):
                some = take[:, c]
                if some.any():
                    # vectors whose distance to the pivot fits some query of the block
                    a = np.searchsorted(gap[lo:hi], (own[some, c] - chord[some]).min() - _SLACK)
                    b = np.searchsorted(gap[lo:hi], (own[some, c] + chord[some]).max() + _SLACK, side="right")
                    pick.append(np.arange(lo + a, lo + b))
            pick = np.concatenate(pick) if pick else np.empty(0, np.int64)
            if not len(pick):
                continue
            types = rows["type"].to_numpy()[pick] if typed else None
            allowed = [(v, np.isin(types, list(k))) for k, v in _group_types(list(part["types"])).items()] if typed else None
            row, query, far = _nearest(emb[pick], x, np.maximum(part["k"].to_numpy(), 1), least, allowed)
            row = pick[row]
            out.append(pd.DataFrame({"query_id": part["query_id"].to_numpy()[query], "id": rows["id"].to_numpy()[row],
                                     "_key": rows["_key"].to_numpy()[row], "distance": far}))
        return pd.concat(out) if out else none

    def found(asks: DataFrame) -> DataFrame:
        fields = [*asks.schema.fields, T.StructField("group", T.IntegerType())]
        asked = asks.mapInPandas(ask, T.StructType(fields))
        # every part of the queries takes a copy of the groups
        copies = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(ask_parts - 1))))
        return copies.groupBy("group", "part").cogroup(asked.groupBy("group", "part")).applyInPandas(search, _cand_schema(key_type))

    first = materialize(found(dealt), "knn-first")
    place = Window.partitionBy("query_id").orderBy("distance")
    limit = first.withColumn("pos", F.row_number().over(place)).join(q.select("query_id", "k"), "query_id")
    limit = limit.where(F.col("pos") == F.greatest("k", F.lit(1))).select("query_id", F.col("distance").alias("theta"))
    return found(dealt.join(limit, "query_id", "left").select(*dealt.columns, "theta"))


def _pack(rows, k_col, types_col):
    vecs = np.stack([np.asarray(r["qvec"], dtype=np.float64) for r in rows])
    norms = np.sqrt((vecs * vecs).sum(axis=1))
    keep = norms > 0
    rows = [r for r, kp in zip(rows, keep) if kp]
    return {
        "vecs": vecs[keep],
        "norms": norms[keep],
        "ids": np.array([r["query_id"] for r in rows], dtype=np.int64),
        "k": np.array([max(int(r[k_col]), 1) for r in rows], dtype=np.int64),
        "types": _group_types([r[types_col] for r in rows]) if types_col else None,
    }


def _group_types(lists):
    """{allowed type tuple: query columns} for queries that filter by type."""
    groups: dict[tuple, list[int]] = {}
    for j, t in enumerate(lists):
        if t is not None and len(t):
            groups.setdefault(tuple(t), []).append(j)
    return {k: np.array(v, dtype=np.int64) for k, v in groups.items()}


def normalise_distance(cands: DataFrame) -> DataFrame:
    """V4: ``vec_norm = 1 - d / max(max d over the query's candidates, 1)``."""
    w = Window.partitionBy("query_id")
    return cands.withColumn(
        "vec_norm", 1 - F.col("distance") / F.greatest(F.max("distance").over(w), F.lit(1.0))
    )
