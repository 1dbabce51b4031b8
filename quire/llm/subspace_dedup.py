"""Embedding near-duplicates by a subspace pigeonhole join (operator 10).

Unit vectors with cosine at least ``t`` are at squared distance at most
``2 - 2t``.  A fixed random rotation spreads that distance over ``blocks`` groups of
coordinates; in at least one block of ``w`` of the ``d`` coordinates it is then at
most the proportional budget ``(2 - 2t) * w / d``.  Each block is range-joined under
its budget, and every pair found in some block is verified exactly by its
cosine in double precision.

The range join of a block cuts the space at the medians' place, zero, of the
block's leading ``cuts`` coordinates (cells).  A vector is at home in one cell and is also
sent to every later cell that the ball of the block's radius around it touches,
so each pair within the budget meets exactly once per block.  Cells are
dealt as pairs of chunks of bounded size, so neither a hot label nor a dense
region meets in one task.  A task returns link counts and a spanning forest,
one row per vector at most, never the links themselves.  A pair within budget
in several blocks is counted in the first.

Equal vectors of a label are one representative with a multiplicity.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components, and rows with a null label, link with nothing; vectors of different
length are not compared; repeated rows are vectors of their own, and different
vectors with the same smallest ``vec_id`` share links and class; a row with a null
``vec_id`` links with nothing and is returned with a null component and ``kept``
false; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import components, materialize, table

_SLACK = 1e-9


def rotation(d: int, seed: int = 10) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def turned_units(x: np.ndarray) -> np.ndarray:
    """Rotated unit vectors; a row's values do not depend on the other rows.

    The sum runs outside BLAS, whose order of addition may change with the batch.
    """
    unit = x / np.abs(x).max(axis=1)[:, None]
    unit /= np.sqrt(_dots(unit, unit))[:, None]
    return np.einsum("ij,jk->ik", unit, rotation(x.shape[1]))


def block_bounds(d: int, blocks: int) -> list[tuple[int, int]]:
    edge = [round(i * d / blocks) for i in range(blocks + 1)]
    return [(a, b) for a, b in zip(edge, edge[1:]) if b > a]


def cells(x: np.ndarray, radius: float, cuts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home) of every cell a block's rows are sent to.

    A cell is the sign pattern of the leading coordinates.  Beside its own, a row goes to the cells
    with a larger number whose region the ball of ``radius`` around it touches.
    """
    lead = x[:, :cuts]
    k = lead.shape[1]
    home = ((lead >= 0) * (1 << np.arange(k))).sum(axis=1)
    rows, where, own = [np.arange(len(x))], [home], [np.ones(len(x), bool)]
    sq = lead * lead
    for flip in range(1, 1 << k):
        bits = [(flip >> i) & 1 for i in range(k)]
        other = home ^ flip
        hit = np.flatnonzero((sq @ np.array(bits, float) <= radius * radius) & (other > home))
        rows.append(hit)
        where.append(other[hit])
        own.append(np.zeros(len(hit), bool))
    return np.concatenate(rows), np.concatenate(where), np.concatenate(own)


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise products, summed in the same order whatever the batch."""
    return np.add.reduce(x * y, axis=1)


def meet(left: dict, right: dict | None, block: int, bounds: list[tuple[int, int]], budget: np.ndarray,
         cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the links of ``left`` x ``right`` counted in ``block``.

    ``right`` None: the pairs inside ``left``.
    """
    other = left if right is None else right
    a, b = bounds[block]
    found = [], []
    xs, ys = left["turned"][:, a:b], other["turned"][:, a:b]
    ny = (ys * ys).sum(axis=1)
    for at in range(0, len(xs), 1024):
        x = xs[at : at + 1024]
        near = (x * x).sum(axis=1)[:, None] + ny[None, :] - 2 * (x @ ys.T) <= budget[block] + 1e-7
        if right is None:
            near &= np.arange(at, at + len(x))[:, None] < np.arange(len(ys))[None, :]
        i, j = np.nonzero(near)
        for lo in range(0, len(i), 200_000):  # dense regions: bounded slices of candidates
            p, q = i[lo : lo + 200_000] + at, j[lo : lo + 200_000]
            gap = left["turned"][p] - other["turned"][q]
            gap *= gap
            ok = gap[:, a:b].sum(axis=1) <= budget[block]
            for earlier in range(block):
                c, d = bounds[earlier]
                ok &= ~(gap[:, c:d].sum(axis=1) <= budget[earlier])
            p, q = p[ok], q[ok]
            ok = _dots(left["vec"][p], other["vec"][q]) / (left["norm"][p] * other["norm"][q]) >= cosine
            found[0].append(p[ok])
            found[1].append(q[ok])
    none = np.empty(0, np.int64)
    return np.concatenate([*found[0], none]), np.concatenate([*found[1], none])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each of n positions over the pairs."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[i], low[j])
        nxt = low.copy()
        np.minimum.at(nxt, low[i], m)
        np.minimum.at(nxt, low[j], m)
        while (hop := nxt[nxt]).tobytes() != nxt.tobytes():
            nxt = hop
        if (nxt == low).all():
            return low
        low = nxt


def near_vectors(vectors: DataFrame, cosine: float = 0.98, blocks: int = 4, cuts: int = 4, chunk: int = 512,
                 ident: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Rows with equal labels are linked if their cosine is at least ``cosine``.
    """
    base = vectors.select(F.col(ident).cast("long").alias("id"), F.col(label).alias("label"),
                          F.col(vector).cast("array<double>").alias("vec"))
    usable = F.coalesce(
        F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0)
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vec", lambda x: x != 0), F.lit(False))
    good = base.where(usable)
    # 0.0 + x turns -0.0 into 0.0, so that equal vectors are equal bytes
    reps = good.groupBy("label", F.transform("vec", lambda x: x + F.lit(0.0)).alias("vec")).agg(
        F.min("id").alias("rep"), F.count("*").alias("copies"))
    reps = materialize(reps, "vectors")
    packed = np.float32 if dict(vectors.dtypes)[vector] == "array<float>" else np.float64  # exact in either

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, part in pdf.groupby(pdf["vec"].map(len)):
                x = np.array(part["vec"].tolist(), float)
                turned = turned_units(x)
                raw = np.array([v.tobytes() for v in x.astype(packed)], object)
                for k, (a, b) in enumerate(block_bounds(d, blocks)):
                    radius = np.sqrt((2 - 2 * cosine + _SLACK) * (b - a) / d) + 1e-6
                    row, cell, own = cells(turned[:, a:b], radius, cuts)
                    yield pd.DataFrame({
                        "label": part["label"].to_numpy()[row], "dim": d, "block": k, "cell": cell, "home": own,
                        "rep": part["rep"].to_numpy()[row], "copies": part["copies"].to_numpy()[row],
                        "vec": raw[row]})

    label_type = dict(base.dtypes)["label"]
    key = ["label", "dim", "block", "cell"]
    sent = materialize(reps.select("label", "vec", "rep", "copies").mapInPandas(
        spread, f"label {label_type}, dim int, block int, cell long, home boolean, rep long, copies long, "
                "vec binary"), "cells")
    # Home and sent rows are cut into chunks apart; a home chunk meets itself, the later ones and all sent ones.
    # Both numbers are per cell: (labels x blocks x 2**cuts) rows, not a list of vectors.
    load = sent.groupBy(*key).agg(F.count_if("home").alias("at_home"), F.count_if(~F.col("home")).alias("visits"))
    load = load.select(*key, F.ceil(F.col("at_home") / chunk).alias("homes"), F.ceil(F.col("visits") / chunk).alias("guests"))
    dealt = sent.join(load, key).where("homes > 0")
    part = F.pmod(F.xxhash64("rep", "vec", F.lit(7)), F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests")))
    dealt = dealt.withColumn("part", part)
    one = F.lit(1).cast("long")
    zero = F.lit(0).cast("long")
    # (i, j): home chunk i with home chunk j >= i, or with sent chunk j - homes
    with_homes = F.transform(F.sequence(zero, F.col("homes") - one), lambda o: F.struct(
        F.least(o, F.col("part")).alias("i"), F.greatest(o, F.col("part")).alias("j")))
    with_guests = F.when(F.col("guests") > 0, F.transform(F.sequence(zero, F.greatest(F.col("guests") - one, zero)),
                         lambda g: F.struct(F.col("part").alias("i"), (F.col("homes") + g).alias("j"))))
    as_guest = F.transform(F.sequence(zero, F.col("homes") - one), lambda o: F.struct(
        o.alias("i"), (F.col("homes") + F.col("part")).alias("j")))
    pairs = F.when(F.col("home"), F.concat(with_homes, F.coalesce(with_guests, F.expr(
        "array()").cast("array<struct<i:bigint,j:bigint>>")))).otherwise(as_guest)
    dealt = dealt.withColumn("pair", F.explode(pairs)).select(
        *key, "pair.i", "pair.j", (F.col("home") & (F.col("part") == F.col("pair.i"))).alias("left"), "rep",
        "copies", "vec")

    def side(g: pd.DataFrame) -> dict:
        vec = np.stack([np.frombuffer(v, packed) for v in g["vec"]]).astype(float)
        return {"vec": vec, "norm": np.sqrt(_dots(vec, vec)), "turned": turned_units(vec), "rep": g["rep"].to_numpy(), "copies": g["copies"].to_numpy()}

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["left"].to_numpy()
        empty = pd.DataFrame({"rep": [], "links": [], "root": []}).astype("int64")
        alone = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        if not own.any() or (not alone and own.all()) or (alone and len(pdf) < 2):
            return empty
        a, b = side(pdf[own]), None if alone else side(pdf[~own])
        d = a["vec"].shape[1]
        bounds = block_bounds(d, blocks)
        budget = np.array([(2 - 2 * cosine + _SLACK) * (q - p) / d for p, q in bounds])
        i, j = meet(a, b, int(pdf["block"].iloc[0]), bounds, budget, cosine)
        if not len(i):
            return empty
        if b is None:
            rep, copies = a["rep"], a["copies"]
        else:
            rep, copies = np.concatenate([a["rep"], b["rep"]]), np.concatenate([a["copies"], b["copies"]])
            j = j + len(a["rep"])
        count = np.zeros(len(rep), np.int64)
        np.add.at(count, i, copies[j])
        np.add.at(count, j, copies[i])
        hit = np.flatnonzero(count)
        return pd.DataFrame({"rep": rep[hit], "links": count[hit], "root": rep[forest(len(rep), i, j)[hit]]})

    linked = materialize(dealt.groupBy(*key, "i", "j").applyInPandas(links, "rep long, links long, root long"), "links")
    counts = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(linked, "rep", "root", "vectors").withColumnRenamed("node", "rep")

    copies = reps.select("rep", "copies", F.col("vec").alias("v"), F.col("label").alias("l"))
    known = copies.join(counts, "rep", "left").join(roots, "rep", "left").select(
        "v", "l", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "rep").alias("component"))
    keyed = base.withColumn("v", F.when(usable, F.transform("vec", lambda x: x + F.lit(0.0))))
    keyed = keyed.select("id", "label", "v").withColumn("l", F.when(F.col("v").isNotNull(), F.col("label")))
    out = keyed.join(known, ["v", "l"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def op10_subspace_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of all embeddings under cosine 0.98 within a label."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op10_subspace_near_vectors": op10_subspace_near_vectors}

ORACLE = {"op10_subspace_near_vectors": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (
  SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
   AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, coalesce(deg.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(low.m, v.vec_id)) AS component_id,
       v.vec_id = least(v.vec_id, coalesce(low.m, v.vec_id)) AS kept
FROM v LEFT JOIN low ON v.vec_id = low.a LEFT JOIN deg ON v.vec_id = deg.a
"""}
