"""Mixture-controlled packing by deficit round-robin over source queues (operator 12).

Every source is a queue of its documents' tokens.  A round stands for one window: each
queue earns ``window * target share`` tokens, and the whole units of ``grain`` tokens that it has earned
are served, in the order of the queues; what is left, its deficit, is carried to the next round.  The rounds follow each other
without a gap and are cut into full windows (sequences), so any window holds the target proportions up to a unit or two of each source.
A queue that has run out serves nothing more; the others keep their proportions.  The default targets are the sources' own shares
of all tokens, under which all queues run out together.

The tokens that a queue has served by the end of round ``w`` are ``grain * floor(w * window * share / grain)``, at most all of them:
the carried deficits have a closed form.  A task therefore needs only the totals of the queues and where its rows stand in theirs to place
its documents, and no window waits for an earlier one.

The last tokens, fewer than a window, fill sequences whose lengths are falling powers of two, which need no padding.

Scale: sources below one token a window (``1 / window`` of all tokens) have no proportion to keep in a window and share one queue, so there
are at most ``window + 1`` queues whatever the data; their totals go to the tasks.  Texts are tokenised once; ids are written with the task
they came from and the tokens of their source before them there, and a join with the starts by task and source gives positions.
No source meets in one task.

Defined results: a null or empty text has the end id alone; bytes that are no UTF-8 read as U+FFFD; strings of special tokens in texts become
these tokens; a null source is a queue of its own; repeated rows are packed each; ids may be null and of any type; an empty table gives no rows; extra
columns are ignored.

Texts are cut at spaces where needed: the tokenizer drops white space between words and joins nothing across it.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import materialize, running, table
from quire.llm.tokens import RankedPairs, json_tokenizer, once, ranges, readable, slices, stable


# ---------------------------------------------------------------- the schedule

def muldiv(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(quotient, remainder) of ``a * b / c`` for int64 with a quotient below 2**50; the product may be larger than 64 bits."""
    a, b, c = np.broadcast_arrays(np.asarray(a, np.int64), np.asarray(b, np.int64), np.asarray(c, np.int64))
    q = np.floor(a.astype(float) * (b.astype(float) / c)).astype(np.int64)
    with np.errstate(over="ignore"):
        r = a * b - q * c  # right modulo 2**64, and small
    for _ in range(2):
        up, down = r >= c, r < 0
        q, r = q + up - down, r - np.where(up, c, 0) + np.where(down, c, 0)
    return q, r


class Schedule:
    """Where each token of each queue goes.

    ``totals``: tokens of every queue; ``weights``: whole numbers, the target proportions.
    """

    def __init__(self, totals: list[int], weights: list[int], window: int, grain: int):
        self.total = np.array(totals, np.int64)
        self.weight = np.array(weights, np.int64)
        self.sum, self.window, self.grain = int(sum(weights)), window, grain
        n = int(sum(totals))
        self.full = n // window
        rest = n % window
        sizes = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        self.tail = self.full * window + np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def served(self, rounds: np.ndarray, queue: np.ndarray | slice) -> np.ndarray:
        """Tokens of the queues served before the rounds."""
        units, _ = muldiv(rounds * self.window, self.weight[queue], np.int64(self.sum * self.grain))
        return np.minimum(units * self.grain, self.total[queue])

    def round_of(self, at: np.ndarray, queue: np.ndarray) -> np.ndarray:
        """The round that serves token ``at`` of the queue."""
        q, r = muldiv(at // self.grain + 1, np.int64(self.sum * self.grain), self.weight[queue] * self.window)
        return q + (r > 0) - 1

    def starts(self, rounds: np.ndarray, queue: np.ndarray) -> np.ndarray:
        """The place in the whole stream where the queue's part of the round begins."""
        each, where = np.unique(rounds, return_inverse=True)
        out = np.empty(len(rounds), np.int64)
        step = max(1, (1 << 19) // len(self.total))
        order = np.argsort(where, kind="stable")
        edge = np.searchsorted(where[order], np.arange(0, len(each) + step, step))
        for k, at in enumerate(range(0, len(each), step)):
            part = each[at : at + step, None]
            before, after = self.served(part, slice(None)), self.served(part + 1, slice(None))
            lead = np.cumsum(after - before, axis=1) - (after - before) + before.sum(axis=1)[:, None]
            mine = order[edge[k] : edge[k + 1]]
            out[mine] = lead[where[mine] - at, queue[mine]]
        return out

    def sequence(self, at: np.ndarray) -> np.ndarray:
        late = self.full + np.searchsorted(self.tail, at, side="right") - 1
        return np.where(at < self.full * self.window, at // self.window, late)

    def first(self, sequence: np.ndarray) -> np.ndarray:
        late = np.clip(sequence - self.full, 0, len(self.tail) - 1)
        return np.where(sequence < self.full, sequence * self.window, self.tail[late])

    def pieces(self, queue: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document number, start, length, sequence, offset) of documents at ``at`` of their queues."""
        low = self.round_of(at, queue)
        doc, r = spread(low, self.round_of(at + size - 1, queue) - low + 1)
        begin = np.maximum(self.served(r, queue[doc]), at[doc])
        end = np.minimum(self.served(r + 1, queue[doc]), (at + size)[doc])
        some = end > begin
        doc, r, begin, end = doc[some], r[some], begin[some], end[some]
        place = self.starts(r, queue[doc]) + begin - self.served(r, queue[doc])
        one = self.sequence(place)
        run, seq = spread(one, self.sequence(place + end - begin - 1) - one + 1)
        start = np.maximum(place[run], self.first(seq))
        stop = np.minimum((place + end - begin)[run], self.first(seq + 1))
        own = (begin - at[doc])[run] + start - place[run]
        doc, size = doc[run], stop - start
        # neighbouring pieces of a document in a sequence are one
        new = np.ones(len(doc), bool)
        new[1:] = ~((doc[1:] == doc[:-1]) & (seq[1:] == seq[:-1]) & (start[1:] == stop[:-1]))
        head = np.flatnonzero(new)
        length = np.add.reduceat(size, head) if len(head) else size
        return doc[head], own[head], length, seq[head], start[head] - self.first(seq[head])


def spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row number, first[row] + 0, 1, ..., count[row] - 1)."""
    row = np.repeat(np.arange(len(first)), count)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, first[row] + inside


# ---------------------------------------------------------------- the operator

class WordIds:
    """Ids of texts under a tokenizer that lower-cases, drops white space and marks the ends of words.

    Texts are cut at spaces and line ends only.  A file with another pipeline is run as it is.
    """

    SPACES = re.compile("[ \n]")

    def __init__(self, tokenizer: str, most: int = 1 << 20):
        t = json_tokenizer(tokenizer, plain=False)
        self.most = most
        self.whole = lambda text: t.encode(text, add_special_tokens=False).ids
        pipeline = json.loads(t.to_str())
        words = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        known = ([n.get("type") for n in (pipeline["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
                 and ((pipeline["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0].get("pattern") == {"Regex": words})
        self.cuts = known
        self.ranked = RankedPairs(tokenizer, r"[^\x00]+\x00") if known else None
        if not known or not self.ranked.usable:
            self.ranked = None
            return
        kinds = stable()
        letters, numbers, spaces = (ranges(kinds[k]) for k in "LNS")
        # the tokenizer's own pattern over stable characters
        self.pieces = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+")
        # what composes, is composed anew, or is lower-cased by its place goes through the file's own pipeline
        every = {chr(c) for k in kinds.values() for c in k}
        safe = [c for k in kinds.values() for c in k if c not in (0, 0x3A3) and not 0x1100 <= c < 0x1200 and every.issuperset(chr(c).lower())
                and unicodedata.category(chr(c))[0] != "M" and unicodedata.normalize("NFC", chr(c)) == chr(c)]
        special = "|".join(re.escape(a["content"]) for a in pipeline["added_tokens"])
        self.unsafe = re.compile(f"[^{ranges(sorted(safe))}]" + (f"|{special}" if special else ""))

    def by_rank(self, text: str) -> np.ndarray:
        found = self.pieces.findall(text.lower())
        return self.ranked.of("\x00".join(found) + "\x00") if found else np.empty(0, np.int64)

    def of(self, text: str) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for part in slices(text, self.most, self.SPACES) if self.cuts else [text]:
            if self.ranked is None:
                out.append(np.array(self.whole(part), np.int64))
            elif not self.unsafe.search(part):
                out.append(self.by_rank(part))
            else:
                for odd, words in groupby(self.SPACES.split(part), lambda w: bool(self.unsafe.search(w))):
                    run = " ".join(words)
                    out.append(np.array(self.whole(run), np.int64) if odd else self.by_rank(run))
        return out


def _encoder(tokenizer: str) -> WordIds:
    return once(("words", tokenizer), lambda: WordIds(tokenizer))


def id_kind(tokenizer: str) -> str:
    return "<u2" if json_tokenizer(tokenizer, plain=False).get_vocab_size() <= 1 << 16 else "<u4"


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, ident: str = "doc_id") -> DataFrame:
    """``id, source, part, before, n, ids``: ``before`` counts the tokens of the source earlier in the task ``part``."""
    width = id_kind(tokenizer)
    kind = docs.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _encoder(tokenizer)
        end = np.array([end_id])
        seen: dict = {}
        part = TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = batch.slice(at, 1000)
                ids = [np.concatenate([*words.of(readable(t)), end]).astype(width) for t in rows.column(1).to_pylist()]
                n = [len(i) for i in ids]
                before = []
                for source, k in zip(rows.column(2).to_pylist(), n):
                    before.append(seen.get(source, 0))
                    seen[source] = before[-1] + k
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(2), pa.array(np.full(len(n), part), pa.int32()), pa.array(before, pa.int64()),
                     pa.array(n, pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary())],
                    names=["id", "source", "part", "before", "n", "ids"])

    rows = docs.select(F.col(ident).alias("id"), F.col("text").cast("binary"), F.col("source").cast("string"))
    return rows.mapInArrow(run, f"id {kind}, source string, part int, before long, n long, ids binary")


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, window: int = 4096, grain: int = 64,
         targets: dict[str | None, float] | None = None, others: float = 1.0, ident: str = "doc_id") -> DataFrame:
    """Pieces ``doc_id, source, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset`` of all documents.

    ``ids`` are unsigned 32-bit little-endian.  ``targets`` gives sources their weights; those it does not name share
    one queue with the weight ``others``.  None: every source's share of all tokens.
    """
    rows = materialize(tokenised(docs, tokenizer, end_id, ident), "tokens")
    parts = rows.groupBy("source", "part").agg(F.sum("n").alias("n"))
    sums = materialize(parts.groupBy("source").agg(F.sum("n").alias("n")), "token-sums")
    total = sums.agg(F.sum("n")).first()[0]
    spark = docs.sparkSession
    kind = docs.schema[ident].dataType.simpleString()
    schema = (f"doc_id {kind}, source string, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, "
              "offset long")
    if total is None:
        return spark.createDataFrame([], schema)
    if targets is None:
        own = sums.where(F.col("n") * window >= total).collect()  # at most ``window`` rows
    elif targets:
        wanted = F.col("source").isin([s for s in targets if s is not None])
        own = sums.where(F.coalesce(wanted, F.lit(False)) | (F.col("source").isNull() & F.lit(None in targets))).collect()
    else:
        own = []
    own = sorted(own, key=lambda r: (r.source is None, r.source))
    totals = [r.n for r in own] + [total - sum(r.n for r in own)]
    if targets is None:
        weights = [max(1, t) for t in totals]
    else:
        given = [targets[r.source] for r in own] + [others]
        weights = [max(1, round(w / max(given) * (1 << 20))) for w in given]
    plan = Schedule(totals, weights, window, grain)

    queues = spark.createDataFrame([(r.source, i) for i, r in enumerate(own)], "source string, queue int")
    parts = parts.join(F.broadcast(queues), parts["source"].eqNullSafe(queues["source"]), "left").select(
        parts["source"], "part", "n", F.coalesce("queue", F.lit(len(own))).alias("queue"))
    # sources are told apart by a key that is not null
    parts = parts.withColumn("key", _key("source"))
    start = running(parts, ["queue"], ["key"], F.col("part"), F.col("n"), "start").select("key", "part", "queue", "start")
    placed = rows.withColumn("key", _key("source")).join(start.hint("shuffle_hash"), ["key", "part"]).select(
        "id", "source", "queue", (F.col("start") + F.col("before")).alias("at"), "n", "ids")
    width = id_kind(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                rows = batch.slice(at, 2000)
                n = rows.column(4).to_numpy()
                doc, begin, length, sequence, offset = plan.pieces(rows.column(2).to_numpy().astype(np.int64), rows.column(3).to_numpy(), n)
                ids = np.frombuffer(b"".join(rows.column(5).to_pylist()), width).astype("<u4")
                first = ((np.cumsum(n) - n)[doc] + begin) * 4
                flat, last = ids.tobytes(), first + length * 4
                cut = [flat[a:b] for a, b in zip(first.tolist(), last.tolist())]
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(take), rows.column(1).take(take), pa.array(begin), pa.array(length), pa.array(cut, pa.binary()),
                     pa.array([zlib.crc32(c) for c in cut], pa.int64()), rows.column(4).take(take), pa.array(sequence), pa.array(offset)],
                    names=["doc_id", "source", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return placed.mapInArrow(run, schema)


def _key(source: str):
    return F.when(F.col(source).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source)))


def op12_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens that keep the sources' shares."""
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")


QUERIES = {"op12_mixture_packing": op12_mixture_packing}
