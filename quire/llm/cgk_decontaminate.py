"""Benchmark decontamination by CGK embedding (operator 2).

Items and documents are sequences of lower-cased words (runs of ASCII letters,
digits and non-ASCII characters; in scripts written without spaces every character is a word,
and full-width punctuation is none).  A document leaks an item of ``n`` words if some
of its consecutive words are within ``k = floor((1 - similarity) * n)`` word edits
of the item.

Search.  A CGK walk reads a sequence, writes the word under its pointer at
every step, and advances by a random bit of (step, word); edit distance becomes
Hamming distance of the written sequence.  ``walks`` walks start at the item and at
each candidate word of a document; ``samples`` times per walk, ``width`` sampled steps
form a key, and an equal key makes a pair.  Candidate starts are those whose
item-sized window holds enough word pairs of the benchmark: ``k`` edits
destroy at most ``2k`` of an item's ``n - 1`` pairs, so this loses nothing.
Every pair is verified by exact semi-global edit distance.

Fewer keys survive the permitted edits the longer an item is.  So an item of more than ``piece_words`` words
is searched by its pieces of about that length, a cut into equal parts: where the whole holds at
most its share of edits, some piece holds at most its own, by pigeonhole.  Each
piece is searched as an item of its length, and the whole item is verified around it.

The defaults reach a recall of 0.99 and more at half the permitted edits and 0.95 at
all of them, for items of 8 to 1000 words (tests).  The documents are read once per block of ``block_items`` items;
only one block's index is shipped at a time, and no document is shuffled.

Items of fewer than ``min_words`` words that permit no edit are too short for keys; they are found exactly,
as whole word sequences.

Defined results: null or empty texts and documents match nothing; null ids are
values of their own; repeated documents or items give one row per pair of ids;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import ALNUM, mix64, parts_for, table, word_hashes, words_of_many

_RNG = np.random.default_rng(2)
_ODD = _RNG.integers(1, 1 << 63, 1 << 14, dtype=np.uint64) | np.uint64(1)
_PAIR = _ODD[:2]
# Han, kana, Bopomofo, Thai, Lao, Tibetan, Myanmar and Khmer: no spaces between words.
_SPACELESS = re.compile("([\u0e00-\u0eff\u0f00-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u3007\u3021-\u3029\u3031-\u3035\u3041-\u312f\u31a0-\u31bf"
                        "\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff])")
_WIDE_MARKS = re.compile("[\u3000-\u3004\u3008-\u3020\u3030\u303d\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")


def spaced(text: str | None) -> bytes:
    """The text in lower case with white space around the characters of scripts without spaces."""
    text = text or ""
    if not text.isascii():
        text = _SPACELESS.sub(r" \1 ", _WIDE_MARKS.sub(" ", text))
    return text.encode().lower()


def pair_hashes(words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(words[:-1] * _PAIR[0] + words[1:] * _PAIR[1])


def edits(n: int, similarity: float) -> int:
    return int((1 - similarity) * n + 1e-9)


def class_floor(n: int) -> int:
    """Smallest item length that shares keys with length n: lengths fall in classes a factor of 1.25 wide."""
    low = 1
    while (nxt := max(low + 1, int(low * 1.25))) <= n:
        low = nxt
    return low


@dataclass
class Index:
    """Keys and words of one block of items."""

    ids: list
    words: list[np.ndarray]
    classes: dict[int, tuple[int, int]]  # floor -> (fewest pairs needed, widest window in pairs)
    pairs: np.ndarray  # sorted pair hashes of all items
    sieve: np.ndarray  # by the top 20 bits of a pair hash
    keys: np.ndarray  # sorted
    owner: np.ndarray  # piece of each key
    piece_item: np.ndarray  # item of each piece
    piece_at: np.ndarray  # first word of each piece in its item
    piece_slack: np.ndarray  # how far an item can begin from where a piece's key puts it
    similarity: float
    walks: int
    samples: int
    width: int
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # number of words -> (sorted sequence hashes, item of each)


def sequence_hashes(line: np.ndarray, n: int) -> np.ndarray:
    """The hash of the ``n`` words from every place of a line."""
    out = np.full(len(line) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = mix64(out * _PAIR[0] + line[j : len(line) - n + 1 + j])
    return out


def walk_keys(words: np.ndarray, starts: np.ndarray, floor: int, index: Index) -> Iterator[np.ndarray]:
    """The keys of every start, one array per (walk, sample)."""
    steps = max(1, int(1.6 * floor))
    padded = np.concatenate([words, np.zeros(1, np.uint64)])
    last = len(words)
    for w in range(index.walks):
        rng = np.random.default_rng([2, floor, w])
        picks = rng.integers(0, steps, (index.samples, index.width))
        at, out = starts.copy(), np.empty((steps, len(starts)), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(steps):
                out[j] = word = padded[at]
                at = np.minimum(at + ((word * _ODD[(w * 1009 + j) % len(_ODD)]) >> np.uint64(63)).astype(np.int64), last)
            for s in range(index.samples):
                salt = np.uint64((floor * index.walks + w) * index.samples + s + 1)
                key = np.full(len(starts), salt)
                for c in range(index.width):
                    key = mix64(key * _PAIR[0] + out[picks[s, c]])
                yield key


def build_index(items: list[tuple], similarity: float = 0.8, walks: int = 8, samples: int = 8, width: int = 3,
                min_words: int = 5, piece_words: int = 48) -> Index:
    ids, words = [], []
    for ident, text in items:
        w = word_hashes(spaced(text), ALNUM)[2]
        if len(w):
            ids.append(ident)
            words.append(w)
    # items without a permitted edit that are too short for keys
    brief = [len(w) < min_words and edits(len(w), similarity) == 0 for w in words]
    short = {}
    for n in sorted({len(w) for w, b in zip(words, brief) if b}):
        own = np.array([i for i, w in enumerate(words) if brief[i] and len(w) == n])
        hashes = np.concatenate([sequence_hashes(words[i], n) for i in own])
        order = np.argsort(hashes, kind="stable")
        short[n] = (hashes[order], own[order])
    # up to a third above piece_words an item stays whole, so that pieces are never short
    counts = [0 if b else 1 if len(w) <= piece_words * 4 // 3 else -(-len(w) // piece_words) for w, b in zip(words, brief)]
    cuts = [np.arange(c + 1) * len(w) // max(c, 1) for w, c in zip(words, counts)]
    pieces = [w[a:b] for w, cut in zip(words, cuts) for a, b in zip(cut[:-1], cut[1:])]
    slack = [edits(len(w), similarity) + (edits(b - a, similarity) if c > 1 else 0)
             for w, c, cut in zip(words, counts, cuts) for a, b in zip(cut[:-1], cut[1:])]
    index = Index(ids, words, {}, np.empty(0, np.uint64), np.zeros(1 << 20, bool), np.empty(0, np.uint64),
                  np.empty(0, np.int64), np.repeat(np.arange(len(words)), np.array(counts, np.int64)),
                  np.concatenate([np.empty(0, np.int64), *(cut[:-1] for cut in cuts)]), np.array(slack, np.int64),
                  similarity, walks, samples, width, short)
    if not pieces:
        return index
    index.pairs = np.unique(np.concatenate([pair_hashes(w) for w, b in zip(words, brief) if not b]))
    index.sieve[(index.pairs >> np.uint64(44)).astype(np.int64)] = True
    floors = np.array([class_floor(len(w)) for w in pieces])
    keys, owner = [], []
    for floor in np.unique(floors):
        own = np.flatnonzero(floors == floor)
        sizes = [len(pieces[i]) for i in own]
        index.classes[int(floor)] = (min(max(1, n - 1 - 2 * edits(n, similarity)) for n in sizes),
                                     max(n - 1 + edits(n, similarity) for n in sizes))
        gap = np.zeros(int(2 * floor) + 2, np.uint64)
        joined = np.concatenate([np.concatenate([pieces[i], gap]) for i in own])
        starts = np.cumsum([0] + [len(pieces[i]) + len(gap) for i in own[:-1]])
        for key in walk_keys(joined, starts, int(floor), index):
            keys.append(key)
            owner.append(own)
    keys, owner = np.concatenate(keys), np.concatenate(owner)
    order = np.argsort(keys, kind="stable")
    index.keys, index.owner = keys[order], owner[order]
    return index


def best_span(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the words of ``text`` nearest to ``item``: semi-global edit distance.

    Ties: the earliest end, then the latest start.
    """
    m = len(text)
    offset = np.arange(m + 1)
    cost, start = np.zeros(m + 1, np.int64), offset.copy()
    for word in item:
        # cost and start in one number, so that minima carry their start with them
        state = cost * (m + 2) + (m + 1 - start)
        down = state + (m + 2)
        diag = state[:-1] + np.where(text == word, 0, m + 2)
        now = down
        now[1:] = np.minimum(down[1:], diag)
        now = np.minimum.accumulate(now - offset * (m + 2)) + offset * (m + 2)
        cost, start = now // (m + 2), m + 1 - now % (m + 2)
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), end


def search(doc: np.ndarray, words: np.ndarray, index: Index) -> list[tuple[int, int, int, int, int]]:
    """(document, item, edits, first word, end word) of the leaks in a run of documents.

    ``doc``: the ascending document number of each word; places count from the document's first word.
    Documents are searched together, with a word that is none between them, at which walks stop.
    """
    if not len(words) or not (len(index.keys) or index.short):
        return []
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    at = np.arange(len(words)) + np.cumsum(new) - 1
    line = np.zeros(at[-1] + 2, np.uint64)
    line[at] = words
    begins = at[new]
    ends = np.append(begins[1:] - 1, len(line) - 1)
    names = doc[new]
    pairs = pair_hashes(line)
    maybe = np.flatnonzero(index.sieve[(pairs >> np.uint64(44)).astype(np.int64)] & (line[:-1] != 0) & (line[1:] != 0))
    maybe = maybe[np.isin(pairs[maybe], index.pairs)]
    hit = np.zeros(len(pairs), bool)
    hit[maybe] = True
    total = np.concatenate([[0], np.cumsum(hit)])
    found: dict[tuple[int, int], dict[int, int]] = {}  # (document, item): where the item may begin, and how far off
    for floor, (need, wide) in index.classes.items():
        if total[-1] < need:
            continue
        window = np.minimum(np.arange(len(hit)) + wide, len(hit))
        starts = np.flatnonzero((total[window] - total[:-1] >= need) & (line[:-1] != 0))
        for lo in range(0, len(starts), 65_536):
            some = starts[lo : lo + 65_536]
            for key in walk_keys(line, some, floor, index):
                first = np.searchsorted(index.keys, key)
                met = np.flatnonzero(index.keys[np.minimum(first, len(index.keys) - 1)] == key)
                last, owns = np.searchsorted(index.keys, key[met], "right"), np.searchsorted(begins, some[met], "right") - 1
                for lo_key, hi_key, own, start in zip(first[met], last, owns.tolist(), some[met].tolist()):
                    for piece in index.owner[lo_key:hi_key].tolist():
                        spots = found.setdefault((own, int(index.piece_item[piece])), {})
                        begin = start - int(index.piece_at[piece])
                        spots[begin] = max(spots.get(begin, 0), int(index.piece_slack[piece]))
    out = []
    for n, (hashes, items) in index.short.items():
        if len(line) < n:
            continue
        key = sequence_hashes(line, n)
        first = np.searchsorted(hashes, key)
        met = np.flatnonzero(hashes[np.minimum(first, len(hashes) - 1)] == key)
        owns = np.searchsorted(begins, met, "right") - 1
        for at_hash, last, own, start in zip(first[met].tolist(), np.searchsorted(hashes, key[met], "right").tolist(), owns, met):
            for item in items[at_hash:last].tolist():
                if np.array_equal(index.words[item], line[start : start + n]):
                    out.append((int(names[own]), item, 0, int(start - begins[own]), int(start + n - begins[own])))
    for (own, item), spots in found.items():
        target = index.words[item]
        n, k = len(target), edits(len(target), index.similarity)
        order, slack = np.array(sorted(spots)), max(spots.values())
        for run in np.split(order, np.flatnonzero(np.diff(order) > k + 1) + 1):
            lo, hi = max(begins[own], run[0] - slack), min(ends[own], run[-1] + slack + n + k)
            # k edits destroy at most 2k of the item's own pairs: fewer left, no leak
            if np.isin(pair_hashes(target), pairs[lo : hi - 1]).sum() < n - 1 - 2 * k:
                continue
            cost, a, b = best_span(target, line[lo:hi])
            if cost <= k:
                out.append((int(names[own]), item, cost, int(lo + a - begins[own]), int(lo + b - begins[own])))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, block_items: int = 10_000,
               **options) -> DataFrame:
    """``doc_id, item_id, edits, similarity, first_word, n_words, n_spans``: the nearest span of every leaked item."""
    # ids are strings in Python: pandas turns whole numbers beside a null into floats
    schema = "doc_id string, item_id string, edits int, similarity double, first_word long, n_words long"
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    spark = docs.sparkSession
    blocks = parts_for(items.count(), block_items)
    numbered = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    found = spark.createDataFrame([], schema)
    for b in range(blocks):
        # about block_items items: a bounded index
        rows = [(r.item_id, r.text) for r in numbered.where(F.col("block") == b).collect()]
        rows.sort(key=lambda r: (r[0] is None, r[0], r[1]))
        shipped = spark.sparkContext.broadcast(build_index(rows, similarity, **options))

        def run(batches: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
            index = shipped.value
            for pdf in batches:
                texts, idents = [spaced(t) for t in pdf["text"]], pdf["doc_id"].to_numpy(object)
                out = []
                for a, _, doc, words in words_of_many(texts, ALNUM):
                    for d, item, cost, first, end in search(doc, words, index):
                        n = len(index.words[item])
                        ident = index.ids[item]
                        out.append((idents[a + d], None if ident is None else str(ident), cost, 1 - cost / n, first, end - first))
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "edits", "similarity", "first_word", "n_words"])

        found = found.union(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, schema))
    nearest = F.min(F.struct("edits", "first_word", "n_words", "similarity")).alias("best")
    out = found.groupBy("doc_id", "item_id").agg(nearest, F.countDistinct("first_word").alias("n_spans"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("item_id").cast("long").alias("item_id"), "best.edits", "best.similarity", "best.first_word", "best.n_words", "n_spans")


def op2_cgk_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks of all benchmark items in all documents."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op2_cgk_decontaminate": op2_cgk_decontaminate}
