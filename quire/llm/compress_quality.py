"""Compression quality classifier (operator 7).

Two zstandard dictionaries are trained, one on good and one on bad labelled
text.  A text is compressed with either, in equal blocks of at most ``BLOCK`` bytes, as a dictionary
tells little about what comes long after it; the normalised difference of the summed sizes,
``(bad - good) / (bad + good)``, together with the two rates (compressed bytes per
byte, which show repetition within a block), the length of a block and whether there are several, is
calibrated to a probability by logistic regression on labelled texts the dictionaries have not seen.

Training data: only labelled rows whose ``crc32(doc_id) mod 4`` is not 2, those with the
smallest hash of the id: of the texts of one block at most ``per_class`` of each label for the
dictionaries and as many again for the calibration; of longer texts, from every power of two of the length,
about ``stratum_bytes`` of text and at least 8 texts of each label, every other for a dictionary.  A dictionary
takes one block of a text, from a place given by its hash; the features of the calibration are made in
tasks from whole texts.  A sampled text weighs as much as the labelled texts of its label and stratum
that it stands for.  These bounds are parameters; they limit what is learned from, never
what is scored: every text is scored whole.  ``error_by_length`` reports the held-out error by length.

Defined results: an empty or null text gets the calibrated score of an empty
text (rates 1, difference 0); duplicate labels of a document count once, the
smaller, and its repeated rows are one row of the sample; with labels of one class only every text
gets that class, without any a score of 0.5;
null ids are scored and count as not held out; repeated rows are scored alike; an empty
table gives no rows; other columns are kept by ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import materialize, table

ACCEPT = 0.7
BLOCK = 16 << 10


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    level: int

    def coders(self) -> list[zstandard.ZstdCompressor]:
        return [zstandard.ZstdCompressor(
            level=self.level, write_content_size=False, write_checksum=False, write_dict_id=False,
            dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO)) for d in (self.good, self.bad)]

    def score(self, features: np.ndarray) -> np.ndarray:
        x = expand((features - self.centre) / self.scale)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Learn the weights from features of texts and their labels."""
        if not len(y) or y.min() == y.max():
            self.weights[0] = 0.0 if not len(y) else 30.0 if y[0] == 1 else -30.0
            return
        self.centre, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        self.centre[-1], self.scale[-1] = 0, 1  # 0 or 1, and perhaps 0 in the whole sample
        self.weights = logistic(expand((x - self.centre) / self.scale), y, weight)


def untrained(good: list[bytes], bad: list[bytes], size: int = 112 << 10, level: int = 3) -> Model:
    return Model(dictionary(good, size), dictionary(bad, size), np.zeros(21), np.zeros(5), np.ones(5), level)


def features(texts: list[bytes], coders: list) -> np.ndarray:
    """Normalised difference, both rates, the log length of a block of each text, and if there are several."""
    out = np.empty((len(texts), 5))
    for i, t in enumerate(texts):
        if not t:
            out[i] = 0, 1, 1, 0, 0
            continue
        n = -(-len(t) // BLOCK)
        blocks = [t[len(t) * j // n : len(t) * (j + 1) // n] for j in range(n)]
        good, bad = (sum(len(c.compress(x)) for x in blocks) for c in coders)
        out[i] = (bad - good) / (bad + good), good / len(t), bad / len(t), np.log(len(t) / n + 1), n > 1
    return out


def expand(x: np.ndarray) -> np.ndarray:
    """Constant, the features, their products."""
    i, j = np.triu_indices(x.shape[1])
    return np.column_stack([np.ones(len(x)), x, x[:, i] * x[:, j]])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 100) -> np.ndarray:
    """Damped Newton steps for weighted ridge logistic regression."""
    total = weight.sum()

    def loss(w: np.ndarray) -> float:
        return (weight * np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ w))).sum() + ridge * total * (w @ w) / 2

    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * total * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * total * np.eye(len(w))
        step, now, size = np.linalg.solve(hess, grad), loss(w), 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary; the texts themselves where there are too few to train on."""
    if len(texts) >= 32:
        try:
            return zstandard.train_dictionary(size, texts).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"\n".join(texts)[-size:]


def held_out(ident: Column) -> Column:
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 3000, stratum_bytes: int = 32 << 20, **options) -> Model:
    """A model from the labelled documents that are not held out."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    text, size = F.xxhash64("text").alias("_text"), F.octet_length("text")
    stratum = F.when(size <= BLOCK, 0).otherwise(F.floor(F.log2(size))).cast("int").alias("_stratum")
    near = ~held_out(F.col("doc_id")) & (size > 0)
    # Ids and hashes alone are joined with the labels; texts are read again for the sample only.
    rows = docs.where(near).select("doc_id", text, stratum).join(known, "doc_id").where("_quality in (0, 1)").distinct()
    rows = materialize(rows, "labelled")
    counts = {(r["_quality"], r["_stratum"]): r["count"] for r in rows.groupBy("_quality", "_stratum").count().collect()}
    grain, picked = 1 << 40, []
    for (value, layer), count in sorted(counts.items()):
        most = max(8, min(2 * per_class, stratum_bytes >> layer)) if layer else 2 * per_class
        # Rows with a small hash, about half as many again as are taken: no task sends a whole sample.
        share = min(1.0, 1.5 * max(most, 100) / count)
        order = F.pmod(F.xxhash64("doc_id"), F.lit(grain))
        side = rows.where((F.col("_quality") == value) & (F.col("_stratum") == layer) & (order <= int(share * grain)))
        got = side.orderBy(order, "doc_id", "_text").limit(most).select("doc_id", "_text").collect()
        # every other text for a dictionary, the rest and any single text for the calibration
        learns = [i % 2 == 0 and len(got) > 1 for i in range(len(got))]
        weight = count / max(1, len(got) - sum(learns))
        picked += [(r.doc_id, r["_text"], len(picked) + i, value, d, weight) for i, (r, d) in enumerate(zip(got, learns))]
    ident = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {ident}, _text long, _n long, _quality int, _learns boolean, _weight double"
    picked = F.broadcast(docs.sparkSession.createDataFrame(picked, schema))  # a bounded sample of ids
    texts = docs.where(near).select("doc_id", text, "text").join(picked, ["doc_id", "_text"])
    place = F.pmod("_text", F.greatest(size - BLOCK, F.lit(0)) + 1).cast("int") + 1
    block = F.substring(F.col("text").cast("binary"), place, F.lit(BLOCK))
    blocks = texts.where("_learns").groupBy("_n", "_quality").agg(F.min(block).alias("block")).collect()
    blocks.sort(key=lambda r: r["_n"])
    model = untrained(*([bytes(r.block) for r in blocks if r["_quality"] == value] for value in (1, 0)), **options)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coders = model.coders()
        for pdf in batches:
            x = features([t.encode() for t in pdf["text"]], coders)
            yield pd.DataFrame({"n": pdf["_n"], "y": pdf["_quality"], "weight": pdf["_weight"], "x": list(x)})

    rest = texts.where("not _learns").select("_n", "_quality", "_weight", "text")
    rest = rest.mapInPandas(run, "n long, y int, weight double, x array<double>")
    rest = sorted(rest.groupBy("n").agg(F.min(F.struct("y", "weight", "x")).alias("r")).select("n", "r.*").collect())
    model.calibrate(np.array([r.x for r in rest]), np.array([r.y for r in rest]), np.array([r.weight for r in rest]))
    return model


def error_by_length(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """``log2_bytes, quality, n, wrong`` of the held-out labelled rows of ``scored`` (doc_id, text, predicted)."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = scored.where(held_out(F.col("doc_id"))).join(known, "doc_id")
    layer = F.floor(F.log2(F.greatest(F.octet_length("text"), F.lit(1)))).cast("int").alias("log2_bytes")
    return rows.groupBy(layer, "quality").agg(F.count("*").alias("n"), F.sum((F.col("predicted") != F.col("quality")).cast("int")).alias("wrong"))


def score(docs: DataFrame, model: Model, to: str = "score", accepted: str = "predicted") -> DataFrame:
    """``docs`` with ``score`` (probability of label 1) and ``predicted``, or columns of other names."""
    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coders = model.coders()
        for texts in batches:
            yield pd.Series(model.score(features([(t or "").encode() for t in texts], coders)))

    out = docs.drop(to, accepted).withColumn(to, scored("text"))
    return out.withColumn(accepted, (F.col(to) >= ACCEPT).cast("int"))


def op7_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op7_compression_quality": op7_compression_quality}
