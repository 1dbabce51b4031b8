"""Cross-tokenizer alignment by galloping intersection of token ends (operator 11).

The byte offsets where the tokens of two tokenizers end are two rising lists that share their last entry.
The shorter list of a document drives: each of its ends is searched in the longer list by doubling steps from
a place known to be too early, then by halving the last step.  Ends found in both lists cut the document into groups; the differences of
their ranks in either list are the ranges of tokens that overlap.  Every pair of an A and a B token of a group is a link.

Documents are aligned many at a time: their lists follow each other, and all searches step together.

The corpus-wide count of an id pair is the number of documents that hold it linked.  Documents are dealt to chunks of
``chunk`` bytes of text as their tasks read them; a chunk's distinct pairs, with its own counts, are summed by pair over all chunks, and
the sums return to the chunks, where the documents look them up.  So what is shuffled by pair is a chunk's distinct pairs, a frequent pair
has one row a chunk, and no pair's documents meet anywhere.  A chunk is the unit of memory; a longer text is a chunk of its own.
The highest count of each A id, at most one row an entry of A's vocabulary, is the only table sent to all tasks.

Defined results: a null or empty text, one that is no UTF-8, and one whose token bytes are not those of the text with a leading space have
no tokens (zeros, empty digest) and count for no pair; a null id is kept; repeated rows are documents each; an empty table gives no
rows; extra columns are ignored.

Very long texts are encoded in slices, cut before a space that follows a character that is no white space.  A's pre-tokenizer cuts there,
and no piece of B holds a space after another character (checked when B is loaded; otherwise texts are encoded whole).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import materialize, table
from quire.llm.mixture_packing import spread
from quire.llm.tokens import RankedPairs, byte_letters, json_tokenizer, once, piece_tokenizer, ranges, slices, stable

_STRIDE = 16
_LINKS = 1 << 21  # links expanded at once


# ---------------------------------------------------------------- the two tokenizers

class Side:
    """What a batch needs to know of a tokenizer: the bytes and the numbers of its ids."""

    def __init__(self, pieces: list[bytes]):
        self.n, self.pieces = len(pieces), pieces
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.kind = "<u2" if self.n <= 1 << 16 else "<u4"


class Pair:
    """Tokenizers A (byte-level pairs) and B (pieces), and the ids of a text under both."""

    def __init__(self, a: str, b: str, most: int = 1 << 20):
        import public_tokenizers

        ta, tb = json_tokenizer(a, plain=True), piece_tokenizer(b)
        letter = byte_letters()
        added = set(ta.get_added_tokens_decoder())
        entry = [ta.id_to_token(i) or "" for i in range(ta.get_vocab_size())]
        self.a = Side([t.encode() if i in added else bytes(letter[c] for c in t) for i, t in enumerate(entry)])
        names = [tb.id_to_piece(i) for i in range(tb.get_piece_size())]
        self.b = Side([bytes([int(t[3:5], 16)]) if tb.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(names)])
        # white space other than U+2581 in a piece, or that after another character, would tie words together
        glued = any(not tb.is_control(i) and not tb.is_unknown(i) and re.search(r"[^▁][▁ ]", t) for i, t in enumerate(names))
        self.cut = None if glued else re.compile(r"(?<=\S) (?=.)", re.S)
        self.most = most
        self.whole = lambda text: ta.encode(text, add_special_tokens=False).ids
        self.pieces = tb.encode
        pre = json.loads(ta.to_str())["pre_tokenizer"] or {}
        byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        if not byte_level or ta.normalizer is not None:
            raise ValueError(f"{a} is no byte-level tokenizer without normalisation")
        ranked = RankedPairs(a, public_tokenizers.PATTERN)
        self.ranked = ranked if ranked.usable else None
        self.unsafe = re.compile(f"[^{ranges(sorted(c for v in stable().values() for c in v))}]")
        number = [[str(i).encode() for i in range(s.n)] for s in (self.a, self.b)]
        # a token's number with what follows it inside a group, and at the end of its side of the group
        self.text = [np.array([v + b"," for v in n] + [v + end for v in n], object) for n, end in zip(number, (b"|", b";"))]

    def ids_a(self, text: str) -> list[np.ndarray]:
        """A's ids of the text with a leading space; byte-level pairs lose nothing."""
        if self.ranked and not self.unsafe.search(text):
            return [self.ranked.of(" " + text)]
        if not (self.ranked and self.cut):
            return [np.array(self.whole(" " + text), np.int64)]
        out = []
        for odd, words in groupby(self.cut.split(text), lambda w: bool(self.unsafe.search(w))):
            run = " " + " ".join(words)
            out.append(np.array(self.whole(run), np.int64) if odd else self.ranked.of(run))
        return out

    def ids(self, raw: bytes | None) -> tuple[bytes, bytes]:
        try:
            text = raw.decode() if raw else ""
        except UnicodeDecodeError:
            return b"", b""
        if not text:
            return b"", b""
        a: list[np.ndarray] = []
        b: list[int] = []
        parts = slices(text, self.most, self.cut) if self.cut else [text]
        for i, part in enumerate(parts):  # all but the first begin with the space that both tokenizers add
            a += self.ids_a(part[i > 0 :])
            b += self.pieces(part[i > 0 :])
        first = np.concatenate(a).astype(self.a.kind)
        if b"".join(map(self.b.pieces.__getitem__, b)) != b" " + raw or self.a.size[first].sum() != len(raw) + 1:
            return b"", b""
        return first.tobytes(), np.array(b, self.b.kind).tobytes()


def pair_of(a: str, b: str) -> Pair:
    return once(("pair", a, b), lambda: Pair(a, b))


# ---------------------------------------------------------------- galloping

def gallop(keys: np.ndarray, long: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each key the first place at or after ``begin`` where ``long`` is not below it; one exists."""
    low, step = begin.copy(), 1
    high = begin.copy()
    todo = np.flatnonzero(long[high] < keys)
    while len(todo):  # doubling
        low[todo] = high[todo] + 1
        high[todo] = np.minimum(high[todo] + step, len(long) - 1)
        todo = todo[long[high[todo]] < keys[todo]]
        step *= 2
    todo = np.flatnonzero(low < high)
    while len(todo):  # halving
        middle = (low[todo] + high[todo]) >> 1
        below = long[middle] < keys[todo]
        low[todo[below]] = middle[below] + 1
        high[todo[~below]] = middle[~below]
        todo = todo[low[todo] < high[todo]]
    return low


def common_ends(short: np.ndarray, long: np.ndarray, first: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ranks in ``short``, ranks in ``long``) of the entries in both.

    ``first``: the place of each document's list in ``short``; ``start``: in ``long``.
    """
    if not len(short):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    size = np.diff(np.append(first, len(short)))
    # every 16th entry gallops from the document's beginning, those between from the one before them
    row, far = spread(np.zeros(len(first), np.int64), -(-size // _STRIDE))
    at = first[row] + far * _STRIDE
    found = gallop(short[at], long, start[row])
    gap = np.diff(np.append(at, len(short)))
    place = gallop(short, long, np.repeat(found, gap))
    hit = np.flatnonzero(long[place] == short)
    return hit, place[hit]


class Batch:
    """The alignment of several documents whose ids follow each other."""

    def __init__(self, pair: Pair, ids: list[tuple[bytes, bytes]]):
        a = np.frombuffer(b"".join(x for x, _ in ids), pair.a.kind)
        b = np.frombuffer(b"".join(y for _, y in ids), pair.b.kind)
        wide = [np.dtype(s.kind).itemsize for s in (pair.a, pair.b)]
        self.pair, self.a, self.b = pair, a, b
        self.n_a = np.array([len(x) // wide[0] for x, _ in ids], np.int64)
        self.n_b = np.array([len(y) // wide[1] for _, y in ids], np.int64)
        end_a, end_b = np.cumsum(pair.a.size[a]), np.cumsum(pair.b.size[b])
        to_a, to_b = np.cumsum(self.n_a) - self.n_a, np.cumsum(self.n_b) - self.n_b
        in_a, in_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        drives = self.n_a <= self.n_b
        for docs, x, y, nx, tx, ty, mx, my in ((drives, end_a, end_b, self.n_a, to_a, to_b, in_a, in_b),
                                               (~drives, end_b, end_a, self.n_b, to_b, to_a, in_b, in_a)):
            docs = np.flatnonzero(docs & (nx > 0))
            row, at = spread(tx[docs], nx[docs])
            first = np.cumsum(nx[docs]) - nx[docs]
            i, j = common_ends(x[at], y, first, ty[docs])
            mx[at[i]] = True
            my[j] = True
        # the last token of every group, in either list
        self.last_a, self.last_b = np.flatnonzero(in_a), np.flatnonzero(in_b)
        self.in_a, self.in_b = in_a, in_b
        self.of_a = np.diff(self.last_a, prepend=-1)
        self.of_b = np.diff(self.last_b, prepend=-1)
        self.first_a, self.first_b = self.last_a - self.of_a + 1, self.last_b - self.of_b + 1
        self.doc = np.searchsorted(np.cumsum(self.n_a), self.last_a, side="right")
        n = len(ids)
        self.n_groups = np.bincount(self.doc, minlength=n)
        self.n_links = self._per_doc(self.of_a * self.of_b)
        self.end = end_a[self.last_a] - (end_a[to_a[self.doc]] - pair.a.size[a[to_a[self.doc]]]) if len(self.doc) else self.last_a

    def _per_doc(self, value: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(value)])
        edge = np.concatenate([[0], np.cumsum(self.n_groups)])
        return total[edge[1:]] - total[edge[:-1]]

    def digests(self) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3`` of every document; empty without tokens."""
        merged = np.empty(len(self.a) + len(self.b), object)
        group_a = np.cumsum(self.in_a) - self.in_a
        group_b = np.cumsum(self.in_b) - self.in_b
        text_a, text_b = self.pair.text
        if len(merged):
            merged[np.arange(len(self.a)) + self.first_b[group_a]] = text_a[self.a + self.in_a * np.int64(self.pair.a.n)]
            merged[np.arange(len(self.b)) + self.last_a[group_b] + 1] = text_b[self.b + self.in_b * np.int64(self.pair.b.n)]
        out, at = [], 0
        for n in (self.n_a + self.n_b).tolist():
            out.append(hashlib.sha256(b"".join(merged[at : at + n].tolist())[:-1]).hexdigest() if n else "")
            at += n
        return out

    def pairs(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(document, distinct pair keys, number of links of each) of the documents that have links, in order."""
        each, width = np.int64(self.pair.a.n * self.pair.b.n), np.int64(self.pair.b.n)
        # groups of very many links are expanded by runs of their A tokens
        most = np.maximum(1, _LINKS // self.of_b)
        group, run = spread(np.zeros(len(self.doc), np.int64), -(-self.of_a // most))
        first = self.first_a[group] + run * most[group]
        rows = np.minimum(most[group], self.of_a[group] - run * most[group])
        links = rows * self.of_b[group]
        slot = (np.cumsum(links) - links) // _LINKS
        held: list[tuple[np.ndarray, np.ndarray]] = []
        edges = np.flatnonzero(np.diff(slot, prepend=-1)).tolist() + [len(slot)]
        for p, q in zip(edges, edges[1:]):
            row, r = spread(np.zeros(q - p, np.int64), links[p:q])
            g = group[p:q][row]
            wide = self.of_b[g]
            down = r // wide
            key = self.doc[g] * each + self.a[first[p:q][row] + down] * width + self.b[self.first_b[g] + r - down * wide]
            key, count = np.unique(key, return_counts=True)
            if held and held[-1][0][-1] // each == key[0] // each:
                cut = int(np.searchsorted(key, (key[0] // each + 1) * each))
                held.append((key[:cut], count[:cut]))
                key, count = key[cut:], count[cut:]
                if sum(len(k) for k, _ in held) > 2 * _LINKS:
                    held = [_merged(held)]
                if not len(key):
                    continue
            if held:
                yield from self._documents(*_merged(held), each)
            cut = int(np.searchsorted(key, key[-1] // each * each))  # the last document may go on
            yield from self._documents(key[:cut], count[:cut], each)
            held = [(key[cut:], count[cut:])]
        if held:
            yield from self._documents(*_merged(held), each)

    @staticmethod
    def _documents(key: np.ndarray, count: np.ndarray, each: np.int64) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        doc = key // each
        edges = np.flatnonzero(np.diff(doc, prepend=-1)).tolist() + [len(doc)]
        for p, q in zip(edges, edges[1:]):
            yield int(doc[p]), key[p:q] - doc[p] * each, count[p:q]


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(held) == 1:
        return held[0]
    key, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    count = np.zeros(len(key), np.int64)
    np.add.at(count, where, np.concatenate([c for _, c in held]))
    return key, count


def squeeze(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Rising keys and their counts, small: differences and counts by byte planes, compressed."""
    step = np.diff(keys, prepend=0).astype("<u8")
    wide = 4 if not len(step) or step.max() < 1 << 32 else 8
    tall = 1 if not len(counts) or counts.max() < 256 else 8
    planes = step.view("u1").reshape(-1, 8)[:, :wide].T.tobytes() + counts.astype("<u8").view("u1").reshape(-1, 8)[:, :tall].T.tobytes()
    return bytes([wide, tall]) + once(("zstd",), lambda: zstandard.ZstdCompressor(level=1)).compress(planes)


def unsqueeze(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    wide, tall = data[0], data[1]
    raw = np.frombuffer(once(("unzstd",), zstandard.ZstdDecompressor).decompress(data[2:]), "u1")
    n = len(raw) // (wide + tall)

    def whole(planes: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros((n, 8), "u1")
        out[:, :k] = planes.reshape(k, n).T
        return out.reshape(-1).view("<u8").astype(np.int64)

    return np.cumsum(whole(raw[: wide * n], wide)), whole(raw[wide * n :], tall)


# ---------------------------------------------------------------- the operator

def _slices(rows: pa.RecordBatch, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes of text (column 1), or of one longer text."""
    size = [len(t) + 64 if t is not None else 64 for t in map(pa.BinaryScalar.as_buffer, rows.column(1))]
    at, held = 0, 0
    for i, n in enumerate(size):
        if held and held + n > most:
            yield at, i
            at, held = i, 0
        held += n
    if len(size) > at:
        yield at, len(size)


def aligned(docs: DataFrame, a: str, b: str, chunk: int, ident: str) -> DataFrame:
    """``doc_id, chunk, n_a, n_b, n_groups, n_links, groups_sha256, pairs`` of every document."""
    kind = docs.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(a, b)
        number, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for p, q in _slices(batch):
                rows = batch.slice(p, q - p)
                texts = rows.column(1).to_pylist()
                size = sum(len(t) for t in texts if t)
                if held and held + size > chunk:
                    number, held = number + 1, 0
                held += size
                found = Batch(pair, [pair.ids(t) for t in texts])
                pairs: list[bytes | None] = [None] * len(texts)
                for doc, keys, counts in found.pairs():
                    pairs[doc] = squeeze(keys, counts)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(np.full(len(texts), number), pa.int64()), pa.array(found.n_a), pa.array(found.n_b),
                     pa.array(found.n_groups, pa.int64()), pa.array(found.n_links, pa.int64()), pa.array(found.digests()),
                     pa.array(pairs, pa.binary())],
                    names=["doc_id", "chunk", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])

    rows = docs.select(F.col(ident).alias("doc_id"), F.col("text").cast("binary"))
    return rows.mapInArrow(run, f"doc_id {kind}, chunk long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                                "pairs binary")


def _chunk_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, pair, documents) of rows (chunk, pairs) as they come; a chunk in several pieces gives a row in each."""
    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            key, count = np.unique(np.concatenate(held), return_counts=True)
            for at in range(0, len(key), 1 << 17):
                part = key[at : at + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), now)), pa.array(part), pa.array(count[at : at + (1 << 17)])],
                                                 names=["chunk", "pair", "n"])

    now, held, n = None, [], 0
    for batch in batches:
        for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if data is None:
                continue
            if chunk != now or n > 1 << 23:
                yield from flush()
                now, held, n = chunk, [], 0
            held.append(unsqueeze(data)[0])
            n += len(held[-1])
    yield from flush()


def _look_up(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of a chunk with ``n_best`` and ``count_sum``; ``counts`` holds all their pairs."""
    key = counts.column("pair").to_numpy()
    order = np.argsort(key, kind="stable")
    key, count, best = key[order], counts.column("n").to_numpy()[order], counts.column("best").to_numpy()[order]
    n_best, count_sum = [], []
    for data in docs.column("pairs").to_pylist():
        if data is None:
            n_best.append(0)
            count_sum.append(0)
            continue
        own, links = unsqueeze(data)
        at = np.searchsorted(key, own)
        n_best.append(int(links[best[at]].sum()))
        count_sum.append(int((links * count[at]).sum()))
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))


def align(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", chunk: int = 32 << 20,
          ident: str = "doc_id") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every document."""
    kind = docs.schema[ident].dataType.simpleString()
    found = materialize(aligned(docs, a, b, chunk, ident), "aligned")
    width = piece_tokenizer(b).get_piece_size()
    own = materialize(found.where("pairs is not null").select("chunk", "pairs").mapInArrow(
        _chunk_pairs, "chunk long, pair long, n long"), "chunk-pairs")
    total = own.groupBy("pair").agg(F.sum("n").alias("n"))
    total = materialize(total.withColumn("a", F.expr(f"pair div {width}")), "pair-counts")
    best = total.groupBy("a").agg(F.max("n").alias("most"))  # at most one row an entry of A
    known = total.join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    back = own.select("chunk", "pair").join(known, "pair").select("chunk", "pair", "n", "best")
    schema = (f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, "
              "count_sum long")
    out = found.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(_look_up, schema)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def groups(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", ident: str = "doc_id") -> DataFrame:
    """``doc_id, position, end, a_ids, b_ids``: the groups, with the byte offset in the text and its leading space where each ends."""
    kind = docs.schema[ident].dataType.simpleString()

    def lists(ids: np.ndarray, size: np.ndarray) -> pa.Array:
        edge = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(edge), pa.array(ids.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(a, b)
        for batch in batches:
            for p, q in _slices(batch):
                rows = batch.slice(p, q - p)
                found = Batch(pair, [pair.ids(t) for t in rows.column(1).to_pylist()])
                _, position = spread(np.zeros(len(found.n_groups), np.int64), found.n_groups)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(found.doc)), pa.array(position), pa.array(found.end, pa.int64()),
                     lists(found.a, found.of_a), lists(found.b, found.of_b)], names=["doc_id", "position", "end", "a_ids", "b_ids"])

    rows = docs.select(F.col(ident).alias("doc_id"), F.col("text").cast("binary"))
    return rows.mapInArrow(run, f"doc_id {kind}, position long, end long, a_ids array<int>, b_ids array<int>")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment of all documents under a byte-level and a piece tokenizer."""
    return align(table(spark, sf_dir, "documents"))


QUERIES = {"op11_token_alignment": op11_token_alignment}
