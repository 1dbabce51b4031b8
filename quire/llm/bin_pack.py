"""Sharding by vector bin packing (operator 5).

Documents with equal texts form a group, and every group has three weights: bytes,
tokens and rows.  Groups are placed, heaviest first, where the dot product of
their weights with the shard's residual capacity is highest among the shards
where they still fit (where none has room, where the load stays lowest).
All weights are shares of one shard's capacity (total / shards).

The law that holds is ``bytes``: shards get near equal sizes.  A group heavier than one shard's capacity
in some weight can't be placed whole under any law; it is cut into the fewest
equal pieces of whole rows that fit and its rows are counted through and dealt over them in turn.

Scale: groups heavier than ``heavy`` of the corpus in some weight are at most
``3 / heavy`` plus their pieces, a proven bound; they are placed first, on the
driver.  All other groups are dealt by hash to packers of about ``per_packer`` groups, each of
which packs its groups, in one task, into its share of the room the heavy groups left.

Defined results: a null text is grouped with the empty one (size 1, crc 0); repeated rows are
rows of the group; null ids are dealt like others; an empty table gives no rows; other
columns pass through ``pack`` unless named like one of its own.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import materialize, parts_for, running, table

WORDS = r"[^\x20\x09-\x0D]+"


def place(weights: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Shard of each row of ``weights`` (heaviest first); lowers ``room`` in place."""
    where = np.empty(len(weights), np.int64)
    for k, w in enumerate(weights):
        fits = (room >= w).all(axis=1)
        if fits.any():
            best = int(np.argmax(np.where(fits, room @ w, -np.inf)))
        else:  # no room left in some weight: the law's weight, bytes, decides
            best = int(np.lexsort((-(room @ w), -room[:, 0]))[0])
        where[k] = best
        room[best] -= w
    return where


def pack(docs: DataFrame, shards: int = 16, heavy: float = 1 / 4000, per_packer: int = 20_000) -> DataFrame:
    """``docs`` with ``size, text_crc32, shard, slot``."""
    text = F.coalesce("text", F.lit(""))
    sized = docs.drop("size", "text_crc32", "shard", "slot").withColumn("size", (F.octet_length(text) + 1).cast("long"))
    sized = sized.withColumn("text_crc32", F.crc32(text.cast("binary"))).withColumn("_group", F.sha2(text, 256))
    # where a row was read: tells equal rows apart when they are dealt
    sized = sized.withColumn("_read", F.monotonically_increasing_id())
    tokens = F.regexp_count(text, F.lit(WORDS)).cast("long")
    groups = materialize(
        docs.groupBy(F.sha2(text, 256).alias("g")).agg(
            F.sum(F.octet_length(text) + 1).alias("bytes"), F.sum(tokens).alias("tokens"), F.count("*").alias("rows")),
        "groups")
    total = groups.agg(*[F.sum(c).alias(c) for c in ("bytes", "tokens", "rows")], F.count("*").alias("n")).first()
    capacity = np.array([max(total[c] or 0, 1) / shards for c in ("bytes", "tokens", "rows")])
    share = [F.col(c) / F.lit(float(cap)) for c, cap in zip(("bytes", "tokens", "rows"), capacity)]
    groups = groups.select("g", "rows", *[s.alias(c) for c, s in zip("btr", share)])
    top = F.greatest("b", "t", "r")

    # At most 3 / heavy groups.
    big = groups.where(top >= heavy * shards).collect()
    pieces = []
    for row in big:
        w = np.array([row.b, row.t, row.r])
        n = min(row.rows, max(1, int(np.ceil(w.max() - 1e-9))))  # a row is in one piece
        pieces += [(w / n, row.g, i, n) for i in range(n)]
    pieces.sort(key=lambda p: (-p[0].max(), p[1], p[2]))
    room = np.ones((shards, 3))
    where = place(np.array([p[0] for p in pieces]).reshape(-1, 3), room)
    spark = docs.sparkSession
    placed = spark.createDataFrame([(p[1], p[2], p[3], int(s)) for p, s in zip(pieces, where)],
                                   "g string, piece int, pieces int, shard int")

    packers = parts_for(total["n"] or 0, per_packer)
    left = room / packers

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w = pdf[["b", "t", "r"]].to_numpy(float)
        order = np.lexsort((pdf["g"].to_numpy(), -w.max(axis=1)))
        shard = place(w[order], left.copy())
        return pd.DataFrame({"g": pdf["g"].to_numpy()[order], "piece": 0, "pieces": 1, "shard": shard})

    light = groups.where(top < heavy * shards).withColumn("packer", F.pmod(F.xxhash64("g"), F.lit(packers)))
    light = light.groupBy("packer").applyInPandas(run, "g string, piece int, pieces int, shard int")
    plan = materialize(light.union(placed), "packed")

    # The few cut groups (at most 3 * shards) are looked up in a literal map; all rows then join by group and piece.
    cut = {p[1]: p[3] for p in pieces if p[3] > 1}
    key = F.xxhash64("doc_id", "_read")
    sized = sized.withColumn("_piece", F.lit(0))
    if cut:
        lookup = F.create_map(*reduce(lambda x, y: x + y, [[F.lit(g), F.lit(n)] for g, n in cut.items()]))
        pieces_of = F.try_element_at(lookup, F.col("_group"))
        # rows of a cut group are counted through, so that its pieces differ by one row at most
        split = sized.where(pieces_of.isNotNull()).withColumn("_key", key)
        per = parts_for(total["rows"] or 0, 65_536)
        split = running(split, ["_group"], ["_key"], F.pmod("_key", F.lit(per)), F.lit(1), "_at").drop("_key")
        split = split.withColumn("_piece", F.pmod("_at", pieces_of).cast("int")).drop("_at")
        sized = sized.where(pieces_of.isNull()).unionByName(split)
    rows = sized.join(plan.select(F.col("g").alias("_group"), F.col("piece").alias("_piece"), "shard"), ["_group", "_piece"])
    parts = parts_for(total["rows"] or 0, 4096 * shards)
    rows = running(rows.withColumn("_key", key), ["shard"], ["_key", "doc_id", "text_crc32", "size"],
                   F.pmod("_key", F.lit(parts)), F.lit(1), "slot")
    return rows.drop("_group", "_piece", "_key", "_read")


def op5_vector_bin_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards under the law ``bytes``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _digest(docs)


def _digest(docs: DataFrame) -> DataFrame:
    return pack(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                             F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op5_vector_bin_pack": op5_vector_bin_pack}
