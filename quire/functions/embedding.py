"""Feature-hash embedding (V1) with MurmurHash3 x86-32 (V2), vectorised.

A batch of texts is tokenised in Python (C regex) and handled in pieces of a bounded
number of tokens: a piece's distinct unigram and bigram features are hashed once with
numpy, and its per-document counts are built with one ``bincount``.  Runs inside an ``arrow_udf`` so Spark
partitions the corpus and the work scales with executors; of a batch only a slice of texts is held as Python strings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.schema import EMBEDDING_DIM

# Tokens: runs of ASCII word characters and apostrophes, after lowercasing
# (the same as splitting on everything else and dropping empty pieces).
_TOKEN = re.compile(r"[A-Za-z0-9_']+")

_C1 = np.uint32(0xCC9E2D51)
_C2 = np.uint32(0x1B873593)
_M5 = np.uint32(5)
_N1 = np.uint32(0xE6546B64)
_F1 = np.uint32(0x85EBCA6B)
_F2 = np.uint32(0xC2B2AE35)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint32(r)) | (x >> np.uint32(32 - r))


def murmur3_many(keys: list[bytes], seed: int = 0) -> np.ndarray:
    """MurmurHash3 x86-32 of every key (bytes), as uint32, in input order."""
    n = len(keys)
    if n == 0:
        return np.zeros(0, dtype=np.uint32)
    lens = np.fromiter((len(k) for k in keys), dtype=np.int64, count=n)
    buf = np.frombuffer(b"".join(keys), dtype=np.uint8)
    offs = np.zeros(n, dtype=np.int64)
    np.cumsum(lens[:-1], out=offs[1:])
    return murmur3_packed(buf, offs, lens, seed)


def murmur3_packed(buf: np.ndarray, offs: np.ndarray, lens: np.ndarray, seed: int = 0) -> np.ndarray:
    """MurmurHash3 x86-32 of the keys ``buf[offs[i]:offs[i] + lens[i]]``.

    Keys are processed block by block over the active prefix of a
    length-sorted order, so the cost is proportional to the total bytes.
    """
    n = len(lens)
    if n == 0:
        return np.zeros(0, dtype=np.uint32)
    buf = np.concatenate([buf, np.zeros(4, dtype=np.uint8)])
    nblocks = lens // 4
    order = np.argsort(-nblocks, kind="stable")
    sb = nblocks[order]
    so = offs[order]
    neg = -sb
    h = np.full(n, np.uint32(seed), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for b in range(int(sb[0])):
            active = int(np.searchsorted(neg, -b, side="left"))
            idx = so[:active] + 4 * b
            k = (
                buf[idx].astype(np.uint32)
                | (buf[idx + 1].astype(np.uint32) << np.uint32(8))
                | (buf[idx + 2].astype(np.uint32) << np.uint32(16))
                | (buf[idx + 3].astype(np.uint32) << np.uint32(24))
            )
            k = _rotl(k * _C1, 15) * _C2
            hh = h[:active] ^ k
            h[:active] = _rotl(hh, 13) * _M5 + _N1
        rem = (lens % 4)[order]
        tail_at = so + 4 * sb
        k = np.zeros(n, dtype=np.uint32)
        for j in (2, 1, 0):
            has = rem > j
            k = np.where(has, (k << np.uint32(8)) | buf[np.minimum(tail_at + j, len(buf) - 1)].astype(np.uint32), k)
        k = _rotl(k * _C1, 15) * _C2
        h = np.where(rem > 0, h ^ k, h)
        h ^= lens[order].astype(np.uint32)
        h ^= h >> np.uint32(16)
        h *= _F1
        h ^= h >> np.uint32(13)
        h *= _F2
        h ^= h >> np.uint32(16)
    out = np.empty(n, dtype=np.uint32)
    out[order] = h
    return out


def _ragged_arange(lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(l) for every l in lengths."""
    total = int(lengths.sum())
    starts = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) - np.repeat(starts, lengths)


def murmur3(key: str, seed: int = 0) -> int:
    """Hash of one string, taking the low byte of each UTF-16 code unit."""
    units = key.encode("utf-16-le")
    return int(murmur3_many([bytes(units[0::2])], seed)[0])


def tokens(text: str | None) -> list[str]:
    if not text:
        return []
    return _TOKEN.findall(text.lower())


# Tokens whose features are hashed at a time: bounds the working memory, however many rows a batch has and however
# long its texts are.
PIECE_TOKENS = 1 << 16
# Texts of an Arrow batch that are taken from it at a time.
SLICE_TEXTS = 256


def _pieces(texts: list, most: int) -> Iterator[tuple[int, list[int], list[str], bool]]:
    """``(number of the first text, tokens of each text, tokens, carried)`` of texts that follow each other.

    A piece ends at ``most`` tokens (2 at least), if need be inside a text; the next one is then ``carried``: it begins
    with the token before the cut, which counts for the bigram across it only.
    """
    first, lens, held, carried = 0, [], [], False
    for i, text in enumerate(texts):
        long = text is not None and len(text) > most
        found = (m.group() for m in _TOKEN.finditer(text.lower())) if long else iter(tokens(text))
        lens.append(0)
        while True:
            part = list(islice(found, most - len(held)))
            held += part
            lens[-1] += len(part)
            if len(held) < most:
                break
            yield first, lens, held, carried
            first, lens, held, carried = i, [1], held[-1:], True
    if held:
        yield first, lens, held, carried


def _feature_sums(lens: list[int], flat_tokens: list[str], carried: bool) -> np.ndarray:
    """Matrix (len(lens), 256) of the signed feature counts of one piece.

    Unigrams are hashed once per distinct token of the piece; bigrams once
    per distinct token pair, their bytes (token, zero byte, token) assembled
    with numpy gathers rather than Python string building.
    """
    n = len(lens)
    encoded = pa.array(flat_tokens, pa.large_string()).dictionary_encode()
    codes, uniq = encoded.indices.to_numpy().astype(np.int64), encoded.dictionary.to_pylist()
    # Tokens are ASCII after the split, so latin-1 bytes equal UTF-16 low bytes.
    ub = [u.encode("latin-1", "replace") for u in uniq]
    tlen = np.fromiter((len(b) for b in ub), dtype=np.int64, count=len(ub))
    tbuf = np.frombuffer(b"".join(ub), dtype=np.uint8)
    toff = np.cumsum(tlen) - tlen
    uh = murmur3_packed(tbuf, toff, tlen)
    doc = np.repeat(np.arange(n, dtype=np.int64), lens)
    keys = [doc * EMBEDDING_DIM + (uh[codes] % EMBEDDING_DIM).astype(np.int64)]
    weights = [np.where(uh[codes] & 1, 1.0, -1.0)]
    if carried:
        weights[0][0] = 0.0
    # Bigrams: consecutive tokens of the same document.
    same_doc = doc[:-1] == doc[1:]
    if same_doc.any():
        nu = len(uniq)
        pair = codes[:-1][same_doc] * nu + codes[1:][same_doc]
        upair, pinv = np.unique(pair, return_inverse=True)
        left, right = upair // nu, upair % nu
        la, lb = tlen[left], tlen[right]
        plen = la + 1 + lb
        poff = np.cumsum(plen) - plen
        pbuf = np.zeros(int(plen.sum()), dtype=np.uint8)
        ra = _ragged_arange(la)
        pbuf[np.repeat(poff, la) + ra] = tbuf[np.repeat(toff[left], la) + ra]
        rb = _ragged_arange(lb)
        pbuf[np.repeat(poff + la + 1, lb) + rb] = tbuf[np.repeat(toff[right], lb) + rb]
        ph = murmur3_packed(pbuf, poff, plen)[pinv.reshape(-1)]
        keys.append(doc[:-1][same_doc] * EMBEDDING_DIM + (ph % EMBEDDING_DIM).astype(np.int64))
        weights.append(np.where(ph & 1, 1.0, -1.0))
    sums = np.bincount(np.concatenate(keys), weights=np.concatenate(weights), minlength=n * EMBEDDING_DIM)
    return sums.reshape(n, EMBEDDING_DIM)


def embed_many(texts, piece_tokens: int = PIECE_TOKENS) -> np.ndarray:
    """Matrix (len(texts), 256) float32 of L2-normalised hashed features.

    The counts are whole numbers, so their sums do not depend on how the texts are cut into pieces.
    """
    texts = list(texts)
    mat = np.zeros((len(texts), EMBEDDING_DIM), dtype=np.float64)
    for first, lens, toks, carried in _pieces(texts, piece_tokens):
        mat[first : first + len(lens)] += _feature_sums(lens, toks, carried)
    norms = np.sqrt((mat * mat).sum(axis=1, keepdims=True))
    np.divide(mat, norms, out=mat, where=norms > 0)
    return mat.astype(np.float32)


def embed_one(text: str) -> np.ndarray:
    return embed_many([text])[0]


def _embed_batch(texts: pa.Array) -> pa.Array:
    n = len(texts)
    mat = np.empty((n, EMBEDDING_DIM), dtype=np.float32)
    for at in range(0, n, SLICE_TEXTS):
        mat[at : at + SLICE_TEXTS] = embed_many(texts.slice(at, SLICE_TEXTS).to_pylist())
    ends = np.arange(n + 1, dtype=np.int32) * np.int32(EMBEDDING_DIM)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(mat.reshape(-1)))


# Non-deterministic only as an optimisation barrier (evaluated once per row).
embed_udf = F.arrow_udf(_embed_batch, T.ArrayType(T.FloatType())).asNondeterministic()


def _murmur_batch(keys: pa.Array) -> pa.Array:
    data = [k.encode("utf-16-le")[0::2] if k is not None else b"" for k in keys.to_pylist()]
    return pa.array(murmur3_many(data).astype(np.int64))


# V2 as a column function: hash of each string (low byte of each UTF-16 unit).
murmur3_udf = F.arrow_udf(_murmur_batch, T.LongType())
