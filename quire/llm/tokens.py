"""Token ids of whole texts under public tokenizer files, in bounded memory.

Byte-pair vocabularies of ``tokenizers`` files are run by rank (``tiktoken``), which is
several times faster than the file's own pipeline, wherever both provably agree:

* *merges*: the lowest ranked neighbours whose joined bytes are a token are merged, whatever pair the file lists for that token.  If
  listed merges turn every token's own bytes into that token (checked when a file is loaded), no other pair can come up: as long as
  no merge has crossed a token's borders, the merges inside happen as they do in its bytes alone, where the last two parts are the listed pair.
* *characters*: only texts of characters whose class has been the same since Unicode 3.2 take this way, so
  that the two libraries' character tables cannot differ.

Everything else goes through the file's own pipeline.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np

_loaded: dict = {}


def once(key: tuple, make: Callable):
    """``make()``, kept for the life of the Python worker."""
    if key not in _loaded:
        _loaded[key] = make()
    return _loaded[key]


def place(name: str) -> str:
    """A path, or the name of an installed public tokenizer file."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def json_tokenizer(name: str, plain: bool):
    """A ``tokenizers`` file; ``plain``: special tokens' strings in texts are ordinary text."""
    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(place(name))
        t.encode_special_tokens = plain
        return t

    return once(("json", name, plain), make)


def piece_tokenizer(name: str):
    def make():
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=place(name))

    return once(("piece", name), make)


def readable(text: bytes | None) -> str:
    """A null text is the empty one; bytes that are no UTF-8 become U+FFFD."""
    return text.decode("utf-8", "replace") if text else ""


# ---------------------------------------------------------------- characters

def byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _class(ch: str, category: Callable[[str], str]) -> str:
    kind = category(ch)[0]
    return "S" if ch.isspace() else kind if kind in "LN" else "O"


def _stable() -> dict[str, list[int]]:
    """Code points below U+10000 by class: letters (L), numbers (N), white space (S), others (O)."""
    old = unicodedata.ucd_3_2_0.category
    out: dict[str, list[int]] = {"L": [], "N": [], "S": [], "O": []}
    for cp in range(0x10000):
        ch = chr(cp)
        if 0x1C <= cp <= 0x1F or 0xD800 <= cp < 0xE000 or old(ch) in ("Cn", "Co"):  # white space to some, unassigned, private
            continue
        kind = _class(ch, unicodedata.category)
        if kind == _class(ch, old):
            out[kind].append(cp)
    return out


def ranges(points: list[int]) -> str:
    """The body of a regex class of rising code points."""
    if not points:
        return ""
    p = np.array(points)
    cut = np.flatnonzero(np.diff(p) > 1)
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(p[np.r_[0, cut + 1]], p[np.r_[cut, len(p) - 1]]))


def stable() -> dict[str, list[int]]:
    return once(("stable",), _stable)


# ---------------------------------------------------------------- byte pairs by rank

def listed_merges(text: bytes, end: bytes, rank: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """The parts of ``text`` after merging listed pairs, lowest rank and leftmost first."""
    parts = [text[i : i + 1] for i in range(len(text))]
    if end and parts:
        parts[-1] += end
    while len(parts) > 1:
        best = min((rank.get(p, len(rank)), i) for i, p in enumerate(zip(parts, parts[1:])))
        if best[0] == len(rank):
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return parts


class RankedPairs:
    """A byte-level byte-pair ``tokenizers`` file as ranks; ``usable`` is false where ranks may not do.

    With an end-of-word suffix a piece must end in ``END``, a byte that its text may not hold.
    """

    END = "\x00"

    def __init__(self, name: str, pattern: str):
        import tiktoken

        with open(place(name), encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix = model.get("end_of_word_suffix") or ""
        end = self.END.encode() if suffix else b""
        letter = byte_letters()

        def raw(token: str) -> bytes:
            last = bool(suffix) and token.endswith(suffix)
            return bytes(letter[c] for c in (token[: -len(suffix)] if last else token)) + (end if last else b"")

        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        order = [chr_ for chr_, _ in sorted(letter.items(), key=lambda x: x[1])]  # the letters of bytes 0 to 255
        tokens = [bytes([b]) for b in range(256)]
        ids = [model["vocab"].get(c, 0) for c in order]
        if suffix:
            tokens += [bytes([b]) + end for b in range(256)]
            ids += [model["vocab"].get(c + suffix, 0) for c in order]
        tokens += [raw(a) + raw(b) for a, b in pairs]
        ids += [model["vocab"][a + b] for a, b in pairs]
        rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        self.usable = plain and len(set(tokens)) == len(tokens) and all(
            c + s in model["vocab"] for c in order for s in {"", suffix}) and all(
            len(listed_merges(t[: len(t) - len(end)] if end and t.endswith(end) else t, end if end and t.endswith(end) else b"", rank)) == 1
            for t in tokens[512 if suffix else 256 :])
        self.ids = np.array(ids, np.int64)
        self.encoding = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})

    def of(self, text: str) -> np.ndarray:
        return self.ids[np.array(self.encoding.encode_ordinary(text), np.int64)]


def slices(text: str, most: int, cut: re.Pattern) -> Iterator[str]:
    """``text`` in slices of about ``most`` characters that end before a match of ``cut``, which must not be empty."""
    at = 0
    while len(text) - at > most:
        m = cut.search(text, at + most)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text
