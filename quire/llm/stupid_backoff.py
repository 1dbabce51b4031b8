"""Language-model scores with stupid backoff (operator 3).

Every word of a document is scored by the relative frequency of the longest
n-gram that ends in it and occurs elsewhere in the corpus; each step down costs a
factor ``alpha``.  Counts are taken over all other documents (the document's own
occurrences are subtracted), as a document's own n-grams would always be found.

The computation is relational.  Documents are dealt to chunks of about
``chunk_bytes``; the n-grams exploded from a chunk are added up there (pre-aggregation) and sent, as
sorted hashes with counts, to the partition of the count table that owns
their hash range.  A partition adds the counts of all chunks and returns each chunk the totals of its
own n-grams, in its order; the chunk joins them back to its words by
position and sums per document.  So a frequent n-gram is one entry per chunk,
whatever its frequency, and a partition holds about ``range_entries`` entries.

Words are runs of other than ASCII white space, lower-cased in A-Z.  Of a hash, 40 bits
beside the partition's leading bits are kept: a given n-gram shares its count with another
one with a probability of about ``range_entries / 2**40``.

Defined results: null, empty and wordless texts have 0 words and score 0; the
first words of a text have shorter contexts; repeated rows count as documents of their own;
null ids are scored like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import mix64, parts_for, table, words_of_many

_COEF = np.random.default_rng(3).integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)


def grams(doc: np.ndarray, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(position of the last word, hash) of every n-gram inside a document."""
    m = max(0, len(words) - n + 1)
    with np.errstate(over="ignore"):
        value = np.full(m, np.uint64(n))
        for j in range(n):
            value += words[j : j + m] * _COEF[j]
    inside = doc[:m] == doc[n - 1 : n - 1 + m]
    return np.flatnonzero(inside) + n - 1, mix64(value[inside])


def chunk_words(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(document number, word hash) of every word of a chunk."""
    docs, words = [], []
    for a, _, doc, value in words_of_many([(t or "").encode().lower() for t in texts]):
        docs.append(doc + a)
        words.append(value)
    return (np.concatenate(docs), np.concatenate(words)) if docs else (np.empty(0, np.int64), np.empty(0, np.uint64))


def planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of integers, byte plane by byte plane: leading planes of sorted or
    small numbers are long runs, which the shuffle's compression removes."""
    return np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :].T).tobytes()


def from_planes(data: bytes, width: int) -> np.ndarray:
    wide = np.zeros((len(data) // width, 8), np.uint8)
    wide[:, 8 - width :] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return wide.view(">u8").reshape(-1).astype(np.uint64)


def cut_hashes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Sorted hashes without their leading ``bits``, cut to 40 bits."""
    return (hashes << np.uint64(bits)) >> np.uint64(24)


def log_scores(doc: np.ndarray, n_docs: int, totals: list[np.ndarray], places: list[np.ndarray], grams_of: list[np.ndarray],
               corpus: int, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: sum of the log scores, words, and words scored by an n-gram of the full order.

    ``totals[k]``: corpus count of the distinct (k+1)-grams; ``places[k]``, ``grams_of[k]``:
    last position and number of each occurrence.
    """
    size = np.bincount(doc, minlength=n_docs)
    rest = []  # by position: occurrences of the k-gram that ends there in other documents, or -1
    for total, at, gram in zip(totals, places, grams_of):
        pair, back, own = np.unique(gram.astype(np.int64) * n_docs + doc[at], return_inverse=True, return_counts=True)
        left = np.full(len(doc), -1, np.int64)
        left[at] = total[gram] - own[back]
        rest.append(left)
    # A word that no other document has counts one half.
    best = np.log(np.maximum(rest[0], 0.5)) - np.log(np.maximum(corpus - size[doc], 1)) if len(doc) else np.empty(0)
    order, full = len(totals), np.zeros(len(doc), bool)
    level = np.zeros(len(doc), np.int64)
    for k in range(1, order):
        context = np.concatenate([[-1], rest[k - 1][:-1]]) if len(doc) else rest[k - 1]
        seen = rest[k] > 0
        best = np.where(seen, np.log(np.maximum(rest[k], 1)) - np.log(np.maximum(context, 1)), best)
        level = np.where(seen, k, level)
        full = seen
    steps = np.minimum(np.arange(len(doc)) - np.searchsorted(doc, doc), order - 1) - level  # shorter contexts cost nothing
    best = best + np.maximum(steps, 0) * np.log(alpha)
    return np.bincount(doc, best, minlength=n_docs), size, np.bincount(doc, full, minlength=n_docs).astype(np.int64)


def backoff_scores(docs: DataFrame, order: int = 3, alpha: float = 0.4, chunk_bytes: int = 8 << 20,
                   range_entries: int = 1 << 21) -> DataFrame:
    """``doc_id, n_words, log_score, mean_log_score, full_order`` of every row of ``docs``."""
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    size = docs.agg(F.sum(F.octet_length("text")), F.sum(words)).first()
    total_bytes, corpus = size[0] or 0, size[1] or 0
    chunks = parts_for(total_bytes, chunk_bytes)
    # No more entries than words times orders.
    bits = max(2, int(np.ceil(np.log2(parts_for(corpus * order, range_entries)))))
    dealt = docs.select("doc_id", "text").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    # ids are strings in Python: pandas turns whole numbers beside a null into floats
    dealt = dealt.withColumn("doc_id", F.col("doc_id").cast("string"))

    def distinct(texts: list):
        doc, words = chunk_words(texts)
        for n in range(1, order + 1):
            at, value = grams(doc, words, n)
            yield doc, at, *np.unique(value, return_inverse=True, return_counts=True)

    def edges(values: np.ndarray) -> np.ndarray:
        owners = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        return np.append(np.searchsorted(values, owners), len(values))

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for n, (_, _, values, _, counts) in enumerate(distinct(list(pdf["text"])), 1):
            cut = edges(values)
            for p in range(1 << bits):
                if cut[p + 1] > cut[p]:
                    part = slice(cut[p], cut[p + 1])
                    rows.append((p, n, pdf["chunk"].iloc[0], planes(cut_hashes(values[part], bits), 5),
                                 planes(counts[part], 4)))
        return pd.DataFrame(rows, columns=["part", "n", "chunk", "hashes", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes = [from_planes(h, 5) for h in pdf["hashes"]]
        counts = np.concatenate([from_planes(c, 4) for c in pdf["counts"]])
        _, back = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(back, counts)[back].astype(np.int64)
        cut = np.cumsum([0] + [len(h) for h in hashes])
        answer = [planes(total[a:b], 6) for a, b in zip(cut, cut[1:])]
        return pd.DataFrame({"chunk": pdf["chunk"], "n": pdf["n"], "part": pdf["part"], "totals": answer})

    requests = dealt.groupBy("chunk").applyInPandas(ask, "part int, n int, chunk long, hashes binary, counts binary")
    answers = requests.groupBy("part", "n").applyInPandas(add, "chunk long, n int, part int, totals binary")

    def score(own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        totals, places, numbers, doc = [], [], [], np.empty(0, np.int64)
        for n, (doc, at, values, back, _) in enumerate(distinct(list(own["text"])), 1):
            parts = got[got["n"] == n].sort_values("part")["totals"]
            totals.append(np.concatenate([*(from_planes(t, 6) for t in parts), np.empty(0, np.uint64)]).astype(np.int64))
            places.append(at)
            numbers.append(back)
        total, size, full = log_scores(doc, len(own), totals, places, numbers, corpus, alpha)
        return pd.DataFrame({"doc_id": own["doc_id"], "n_words": size, "log_score": total,
                             "mean_log_score": total / np.maximum(size, 1), "full_order": full})

    scored = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(
        score, "doc_id string, n_words long, log_score double, mean_log_score double, full_order long")
    return scored.withColumn("doc_id", F.col("doc_id").cast("long"))


def op3_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram scores of all documents, each under the counts of the others."""
    return backoff_scores(table(spark, sf_dir, "documents"))


QUERIES = {"op3_stupid_backoff": op3_stupid_backoff}
