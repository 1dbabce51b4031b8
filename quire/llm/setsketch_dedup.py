"""Near-duplicate detection with SetSketch registers (operator 9).

Every document's distinct word shingles fill ``m`` SetSketch registers:
truncated, exponentially spaced values of per-register minima,
``K = clip(floor(1 - log_b(min h)), 0, q + 1)`` with ``h ~ Exp(a)``.  Registers
of a union are the maxima of the registers, and with a base close to 1 two
registers agree with a probability close to the Jaccard similarity.  ``bands`` of
consecutive registers are hashed and documents that share a band are
candidates; in each group of candidates, pairs whose maximum-likelihood joint
estimate is far below the threshold are left out, and all others that could
still join two classes are confirmed on the full shingle sets.

Links are exact (integer comparison of set sizes).  A linked pair is missed
only if no band agrees, with probability ``(1 - s**rows)**bands``: 8e-7 at
similarity 0.85 and 7e-5 at 0.8 for 24 bands of 5.

Work is split so that no key meets in one task: equal sets become one
representative first, candidate classes are found from band minima by a
distributed components job, and a class is confirmed in bundles of bounded
payload, a large one as pairs of chunks that return a spanning forest instead
of all its links.

Defined results: a text without words (or null) has an empty set and is linked
with nothing; repeated rows are classed each by its own text, and sets with the
same smallest ``doc_id`` count as one document; a null ``doc_id`` stands for no
document: its row is returned with the class of the others that have its set
(null if none) and ``kept`` false; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import components, materialize, mix64, parts_for, table, words_of_many

BASE, RATE, TOP = 1.001, 20.0, 65534  # b, a and q of the registers
_SEEDS = np.random.default_rng(9).integers(1, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order.

    Texts with fewer words than ``width`` have their whole word sequence as one.
    """
    coef = _SEEDS[-width:]
    for a, b, doc, word in words_of_many(texts):
        begin = np.searchsorted(doc, np.arange(b - a + 1))
        with np.errstate(over="ignore"):
            n = max(0, len(word) - width + 1)
            rolled = np.zeros(n, np.uint64)
            for j in range(width):
                rolled += word[j : j + n] * coef[j]
            rolled = mix64(rolled)
            for i in range(b - a):
                lo, hi = begin[i], begin[i + 1]
                if hi - lo >= width:
                    yield np.unique(rolled[lo : hi - width + 1])
                elif hi > lo:
                    short = (word[lo:hi] * coef[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
                    yield mix64(np.array([short]))
                else:
                    yield np.empty(0, np.uint64)


def registers(items: np.ndarray, m: int) -> np.ndarray:
    """``m`` SetSketch registers of a set of 64-bit hashes (empty set: zeros)."""
    if not len(items):
        return np.zeros(m, np.uint16)
    low = np.full(m, np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for at in range(0, len(items), 2048):
            np.minimum(low, (items[at : at + 2048, None] * _SEEDS[None, :m]).min(axis=0), out=low)
    uniform = ((low >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    level = 1.0 - np.log(-np.log1p(-uniform) / RATE) / np.log(BASE)
    return np.clip(np.floor(level), 0, TOP + 1).astype(np.uint16)


def joint_similarity(more: np.ndarray, less: np.ndarray, m: int, size_u: np.ndarray, size_v: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard estimates from counts of registers with
    ``K_U > K_V`` (``more``) and ``K_U < K_V`` (``less``) and the known set sizes.

    The likelihood is concave in J; its maximum is bisected on the derivative.
    """
    u = size_u / (size_u + size_v)
    v = 1.0 - u
    scale, log_b = (BASE - 1) / BASE, np.log(BASE)
    p = lambda x: -np.log1p(-x * scale) / log_b
    dp = lambda x: scale / (1 - x * scale) / log_b
    lo, hi = np.zeros(np.shape(more)), np.minimum(u / v, v / u) * np.ones(np.shape(more))
    same = m - more - less
    for _ in range(30):
        j = (lo + hi) / 2
        x, y = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
        px, py = p(x), p(y)
        slope = -more * v * dp(x) / px - less * u * dp(y) / py + same * (v * dp(x) + u * dp(y)) / np.maximum(
            1 - px - py, 1e-12)
        lo, hi = np.where(slope > 0, j, lo), np.where(slope > 0, hi, j)
    return (lo + hi) / 2


def sketch(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, n_shingles, set_key, regs, bands`` of every document (narrow)."""
    m = bands * rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salt = _SEEDS[2048 : 2048 + rows]
        for pdf in batches:
            texts = [(t or "").encode().lower() for t in pdf["text"]]
            sizes, keys, regs = [], [], []
            for s in shingle_sets(texts, width):
                sizes.append(len(s))
                keys.append(hashlib.sha256(s.tobytes()).digest()[:16] if len(s) else None)
                regs.append(registers(s, m))
            grid = np.array(regs, np.uint16).reshape(len(regs), bands, rows).astype(np.uint64)
            with np.errstate(over="ignore"):
                value = mix64((mix64(grid + np.uint64(1)) * salt).sum(axis=2, dtype=np.uint64)
                              + np.arange(bands, dtype=np.uint64) * _SEEDS[0]).view(np.int64)
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "n_shingles": sizes, "set_key": keys,
                "regs": [r.tobytes() for r in regs], "bands": list(value)})

    # ids are strings in Python: pandas turns whole numbers beside a null into floats
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(
        run, "doc_id string, n_shingles long, set_key binary, regs binary, bands array<long>")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


class _Classes:
    """Disjoint classes of positions in one group."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)

    def roots(self) -> np.ndarray:
        while (nxt := self.up[self.up]).tobytes() != self.up.tobytes():
            self.up = nxt
        return self.up


def confirm(sets: list[np.ndarray], regs: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int,
            slack: float = 0.15) -> np.ndarray:
    """Class root (a position) of every set under links left x right.

    ``left`` and ``right`` are positions, equal for a group on its own.  First
    one leader is compared with all; then, while classes differ, the pairs of
    different classes whose sizes allow a link and whose joint estimate is at
    least the threshold less ``slack`` (over four standard errors at 120
    registers) are confirmed on the sets, likeliest first.
    """
    size = np.array([len(s) for s in sets])
    cls = _Classes(len(sets))

    def check(i: int, j: int) -> None:
        if cls.root(i) == cls.root(j) or 100 * min(size[i], size[j]) < percent * max(size[i], size[j]):
            return
        both = np.concatenate([sets[i], sets[j]])
        both.sort()
        common = int((both[1:] == both[:-1]).sum())
        if 100 * common >= percent * (len(both) - common):
            cls.join(i, j)

    for own, other in ((left, right), (right, left)):
        for j in other:
            check(int(own[0]), int(j))
    root = cls.roots()
    if len(np.unique(root[np.concatenate([left, right])])) == 1:
        return root
    m = regs.shape[1]
    for at in range(0, len(left), 256):
        own = left[at : at + 256]
        more, less = (np.zeros((len(own), len(right)), np.int16) for _ in range(2))
        for r in range(m):
            a, b = regs[own, r][:, None], regs[right, r][None, :]
            more += a > b
            less += a < b
        root = cls.roots()
        x, y = np.nonzero((root[own][:, None] != root[right][None, :])
                          & (100 * np.minimum(size[own][:, None], size[right]) >= percent * np.maximum(
                              size[own][:, None], size[right])) & (m - more - less >= m * (percent / 100 - 2 * slack)))
        if not len(x):
            continue
        guess = joint_similarity(more[x, y].astype(float), less[x, y].astype(float), m, size[own[x]], size[right[y]])
        keep = guess >= percent / 100 - slack
        order = np.argsort(-guess[keep], kind="stable")
        for i, j in zip(own[x[keep]][order], right[y[keep]][order]):
            check(int(i), int(j))
    return cls.roots()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 24, rows: int = 5,
                    chunk_docs: int = 1024, chunk_shingles: int = 500_000) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reachable over links, where
    documents are linked if ``100 * |A n B| >= percent * |A u B|`` for their
    sets of ``width``-word shingles.
    """
    sketched = materialize(sketch(docs, width, bands, rows), "sketch")
    sets = materialize(
        sketched.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(
            F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs"),
            F.first("bands").alias("bands")), "sets")

    # Candidate classes: sets that share a band with its smallest set.
    banded = sets.select("rep", F.explode("bands").alias("band"))
    heads = banded.groupBy("band").agg(F.min("rep").alias("head"), F.max("rep").alias("tail")).where("head < tail")
    # Both sides grow with the corpus, and size estimates do not see exploded rows.
    stars = banded.hint("merge").join(heads.select("band", "head"), "band").select(F.col("rep").alias("a"), F.col("head").alias("b"))
    candidate = components(stars, name="candidates").withColumnRenamed("node", "rep")

    # Shares of each class: chunks of bounded rows and payload.
    member = materialize(candidate.join(sets.select("rep", "set_key", "n", "regs"), "rep"), "members")
    total = member.groupBy("component").agg(F.count("*").alias("rows"), F.sum("n").alias("load"))
    total = total.withColumn("chunks", F.greatest(F.ceil(F.col("rows") / chunk_docs),
                                                  F.ceil(F.col("load") / chunk_shingles)))
    small = total.where("chunks = 1").agg(F.sum("rows"), F.sum("load")).first()
    bundles = max(parts_for(small[0] or 0, chunk_docs // 2), parts_for(small[1] or 0, chunk_shingles // 2))

    def with_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [(t or "").encode().lower() for t in pdf["text"]]
            pdf["items"] = [s.tobytes() for s in shingle_sets(texts, width)]
            same = [hashlib.sha256(s).digest()[:16] == bytes(k) for s, k in zip(pdf["items"], pdf["set_key"])]
            yield pdf.drop(columns="text")[same]

    full = docs.select(F.col("doc_id").alias("rep"), "text").join(member, "rep")
    full = full.select("text", "rep", "component", "set_key", "n", "regs").mapInPandas(
        with_sets, "rep long, component long, set_key binary, n long, regs binary, items binary")
    full = full.join(total.select("component", "chunks"), "component")
    chunk = F.pmod(F.xxhash64("rep", F.lit(3)), F.col("chunks"))
    dealt = full.withColumn("chunk", chunk).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    bundle = F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("component"), F.lit(bundles))).otherwise(
        -F.pmod(F.xxhash64("component"), F.lit(1 << 62)) - 1)
    dealt = dealt.select(bundle.alias("bundle"), F.least("chunk", "other").alias("lo"),
                         F.greatest("chunk", "other").alias("hi"), "component", "chunk", "rep", "regs", "items")

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        out_a, out_b = [], []
        for _, g in pdf.groupby("component", sort=False):
            # a document may come twice, if its rows are repeated
            g = g.drop_duplicates(["rep", "items"]).sort_values("rep", kind="stable")
            found = [np.frombuffer(x, np.uint64) for x in g["items"]]
            regs = np.stack([np.frombuffer(x, np.uint16) for x in g["regs"]])
            side, rep = g["chunk"].to_numpy(), g["rep"].to_numpy()
            lo, hi = g["lo"].iloc[0], g["hi"].iloc[0]
            left, right = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
            if not len(left) or not len(right):
                continue
            root = confirm(found, regs, left, right, percent)
            linked = np.flatnonzero(root != np.arange(len(root)))
            out_a.append(rep[linked])
            out_b.append(rep[root[linked]])
        return pd.DataFrame({"a": np.concatenate([*out_a, []]).astype("int64"),
                             "b": np.concatenate([*out_b, []]).astype("int64")})

    forest = materialize(dealt.groupBy("bundle", "lo", "hi").applyInPandas(links, "a long, b long"), "forest")
    found = components(forest, name="links").withColumnRenamed("node", "rep")

    # A document whose rows have several sets joins their classes.
    own = sketched.select("doc_id", "n_shingles", "set_key")
    heads = sets.select("set_key", "rep").join(found, "rep", "left").select(
        "set_key", F.coalesce("component", "rep").alias("component"))
    out = own.join(heads, "set_key", "left").withColumn("component", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"),
                      F.coalesce(F.col("doc_id") == F.col("component"), F.lit(False)).alias("kept"))


def op9_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents under three-word shingles and similarity 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


QUERIES = {"op9_setsketch_near_dedup": op9_setsketch_near_dedup}
