"""Helpers shared by the operators: byte-level words, components, positions."""

from __future__ import annotations

import math
import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.session import checkpoint_dir, materialize, ship_package

__all__ = ["table", "checkpoint_dir", "materialize", "ship_package", "components", "word_hashes", "mix64",
           "NOT_SPACE", "ALNUM", "text_slices", "running", "parts_for"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- words

_codes = np.arange(256)
# Bytes that belong to a word: anything but ASCII white space ...
NOT_SPACE = ~((_codes == 0x20) | ((_codes >= 0x09) & (_codes <= 0x0D)))
# ... or ASCII letters, digits and every non-ASCII byte.
ALNUM = ((_codes >= 0x30) & (_codes <= 0x39)) | ((_codes >= 0x61) & (_codes <= 0x7A)) | (_codes >= 0x80) | (
    (_codes >= 0x41) & (_codes <= 0x5A))

_SLICE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = np.asarray(x, dtype=np.uint64).copy()
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if "fwd" not in _powers or len(_powers["fwd"]) < n:
        size = max(n, _SLICE + (1 << 16))
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            for name, base in (("fwd", _BASE), ("inv", inverse)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                _powers[name] = np.multiply.accumulate(steps)
    return _powers["fwd"], _powers["inv"]


def _hash_slice(data: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = member[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return start, end, np.empty(0, np.uint64)
    fwd, inv = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * fwd[: len(data)], out=total[1:])
        hashes = (total[end] - total[start]) * inv[start]
    return start, end, mix64(hashes)


def word_hashes(text: bytes, member: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte, 64-bit hash) of every maximal run of member bytes.

    The hash is a polynomial over random byte codes, so it depends on the
    word alone.  A text is taken in slices of 1 MiB that end between words,
    which bounds the working memory whatever its length.
    """
    data = np.frombuffer(text, dtype=np.uint8)
    if len(data) <= _SLICE:
        return _hash_slice(data, member)
    parts, at = [], 0
    while at < len(data):
        stop = min(at + _SLICE, len(data))
        while stop < len(data) and member[data[stop - 1]] and member[data[stop]]:
            more = np.flatnonzero(~member[data[stop : stop + _SLICE]])
            stop = stop + int(more[0]) if len(more) else min(stop + _SLICE, len(data))
        start, end, value = _hash_slice(data[at:stop], member)
        parts.append((start + at, end + at, value))
        at = stop
    return tuple(np.concatenate(x) for x in zip(*parts))


def text_slices(texts: list[bytes], most: int = _SLICE):
    """Consecutive index ranges of a batch of at most ``most`` bytes (or one text)."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield first, i
            first, total = i, 0
        total += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def words_of_many(texts: list[bytes], member: np.ndarray = NOT_SPACE):
    """For runs of texts: (first, last, text number of each word, word hash).

    Texts are hashed together, joined by a white-space byte, which keeps the
    per-text overhead small; numbers count from ``first``.
    """
    for a, b in text_slices(texts):
        if b - a == 1:
            _, _, value = word_hashes(texts[a], member)
            yield a, b, np.zeros(len(value), np.int64), value
            continue
        bounds = np.cumsum([len(t) + 1 for t in texts[a:b]])
        start, _, value = _hash_slice(np.frombuffer(b"\n".join(texts[a:b]), np.uint8), member)
        yield a, b, np.searchsorted(bounds, start, side="right"), value


# ---------------------------------------------------------------- graphs

def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "cc") -> DataFrame:
    """(node, component): the smallest node reachable, for nodes with an edge.

    Alternating large-star and small-star rounds over the edge list.  Each
    round is written to the checkpoint folder; only its size and checksum
    come to the driver.  A hub appears in joins only on the side that
    adaptive execution can split, and in partially aggregated minima.
    """
    def put(e: DataFrame) -> tuple[DataFrame, tuple]:
        e = materialize(e.distinct(), name)
        # decimal, so that the checksum cannot overflow under ANSI
        sign = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return e, tuple(sign)

    cur, sign = put(edges.where((F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")))
    while sign[0]:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        low = materialize(low, name)  # written, so that the join's sides are plain exchanges and a hub can be split
        large = both.where("v > u").join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct(), name)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        nxt, new_sign = put(small.union(low.select("u", F.col("m").alias("v"))))
        cur, old, sign = nxt, sign, new_sign
        if sign == old:
            break
    roots = cur.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


# ---------------------------------------------------------------- positions

def running(df: DataFrame, group: list[str], order: list, part, value, out: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of a group, without a window over a whole group.

    ``part`` is a column expression that splits every group into parts of
    bounded size; parts follow each other in its order, and ``order`` orders the
    rows of a part.  Parts are summed by windows of their own and shifted by the
    totals of earlier parts.  Group columns and ``part`` hold no nulls.
    """
    keys = [*group, "_part"]
    parts = df.withColumn("_part", part).withColumn("_value", value)
    totals = parts.groupBy(*keys).agg(F.sum("_value").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(*keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = parts.withColumn("_own", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return (summed.join(shift, keys).withColumn(out, (F.col("_own") + F.col("_before")).cast("long"))
            .drop("_part", "_value", "_own", "_before"))


def parts_for(rows: int, each: int) -> int:
    return max(1, math.ceil(rows / each))
