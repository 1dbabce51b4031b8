"""Text expressions: FTS tokeniser (F1), lengths (P9), snippet."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token characters of the full-text tokeniser: letters, numbers, private use.
FTS_TOKEN_RE = r"[\p{L}\p{N}\p{Co}]+"


def _fold_table() -> tuple[str, str]:
    """Latin letters carrying exactly one diacritic -> their base letter.

    Built from the Unicode decomposition of the Latin-1 Supplement, Latin
    Extended-A/B and Latin Extended Additional blocks, which is what the
    tokeniser's diacritic removal does.
    """
    src, dst = [], []
    for cp in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        ch = chr(cp)
        nfd = unicodedata.normalize("NFD", ch)
        if len(nfd) == 2 and nfd[0].isascii() and nfd[0].isalpha() and unicodedata.category(nfd[1]) == "Mn":
            src.append(ch)
            dst.append(nfd[0])
    return "".join(src), "".join(dst)


def _variants() -> tuple[str, str]:
    """Letters whose case folding is another letter than their lower case (final sigma, long s, ...) -> that letter."""
    known = unicodedata.ucd_3_2_0.category
    base = dict(zip(*_fold_table()))
    found = [c for c in map(chr, (*range(0x80, 0x1300), *range(0x1E00, 0x2000)))
             if known(c)[0] == "L" and len(c.casefold()) == 1 and c.casefold() != c.lower()]
    return "".join(found), "".join(base.get(c.casefold(), c.casefold()) for c in found)


FOLD_FROM, FOLD_TO = (a + b for a, b in zip(_variants(), _fold_table()))

# The combining marks that the tokeniser takes as part of the letter before them and drops.  All
# other marks separate tokens.
FOLDED_MARKS = "".join(map(chr, [
    0x300, 0x301, 0x302, 0x303, 0x304, 0x306, 0x307, 0x308, 0x309, 0x30A, 0x30B, 0x30C, 0x30F, 0x311, 0x31B,
    0x323, 0x324, 0x325, 0x326, 0x327, 0x328, 0x32D, 0x32E, 0x330, 0x331]))


def fold(text: Column) -> Column:
    """Lowercase, drop the folded marks and strip single diacritics from Latin letters, in one pass.

    A text of ASCII alone (as many bytes as characters) has nothing to replace and is not walked letter by letter.
    """
    low = F.lower(text)
    folded = F.translate(low, FOLD_FROM + FOLDED_MARKS, FOLD_TO)
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(folded)


def fts_tokens(text: Column) -> Column:
    """array of folded tokens in order (unicode61-style)."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(FTS_TOKEN_RE), 0)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units, as JavaScript's ``String.length``."""
    return (F.length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def approx_tokens(body_length: Column) -> Column:
    """round(body_length / 4) with halves rounded up, on integers."""
    return F.floor((F.coalesce(body_length, F.lit(0)) + 2) / 4).cast("long")


def utf16_prefix(text: Column, units: int) -> Column:
    """The longest prefix of at most ``units`` UTF-16 code units.

    A surrogate pair that the cut would split is left out, as half of one is no character.
    """
    head = F.substring(F.encode(F.substring(text, 1, units), "UTF-16BE"), 1, 2 * units)
    split_pair = F.hex(F.substring(head, 2 * units - 1, 1)).between("D8", "DB")
    return F.decode(F.when(split_pair, F.substring(head, 1, 2 * units - 2)).otherwise(head), "UTF-16BE")


def snippet(description: Column, body: Column) -> Column:
    """The description when non-empty, else the first 200 UTF-16 units of the body."""
    return F.when(F.coalesce(description, F.lit("")) != "", description).otherwise(
        F.translate(utf16_prefix(F.coalesce(body, F.lit("")), 200), "\n", " ")
    )


def nullif_empty(c: Column) -> Column:
    return F.when(c != "", c)
