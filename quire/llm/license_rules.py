"""License scan by ordered signature rules (operator 6).

Rules are regular expressions over the lower-cased text (A-Z only), in an order of
priority: hand-written signatures of grants, notices, clauses, exceptions and references to files
(``license_signatures``), then the names of license families in the ways licenses are named.  Each is gated by keywords: a rule is tried only on texts that hold one of
its keywords, where white space and hyphens count as one space, so that no gate
turns away a text that its rule matches.  All matches of all admitted rules are detections with an
interval.  In order of priority (then length, then place) a detection is
kept unless its interval lies inside that of one already kept, so a full notice stands
for the mention within it, and a specific version for its family.

Labels are those of the kept detections together with the base labels: the labels of the
places where a base phrase's words stand consecutively.

``score`` is the confidence that the text states a license: that of the surest kept
detection, raised by further ones: ``1 - product(1 - confidence)``; 0 without any.

Defined results: a null text counts as empty: no words, no places, empty labels, score 0; every text is
scanned whole; repeated rows give equal rows; null ids are kept; an empty table
gives no rows; other columns are kept by ``scan`` unless named like a result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import ALNUM, table
from quire.llm.license_signatures import SIGNATURES

# Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Families: label, expression of the name (with an optional group "v" for the version), keywords.
_V = r"(?:[\s,]*(?:\(?\s*(?:version|ver\.?|v\.?)\s*)?(?P<v>\d+(?:\.\d+)*))?"
FAMILIES = [
    ("agpl", rf"(?:gnu\s+affero\s+general\s+public\s+licen[sc]e|\bagpl){_V}", ("affero", "agpl")),
    ("lgpl", rf"(?:gnu\s+(?:lesser|library)\s+general\s+public\s+licen[sc]e|\blgpl){_V}", ("lesser", "library general", "lgpl")),
    ("gpl", rf"(?:gnu\s+general\s+public\s+licen[sc]e|\bgpl){_V}", ("gnu", "gpl")),
    ("gfdl", rf"(?:gnu\s+free\s+documentation\s+licen[sc]e|\bgfdl){_V}", ("free documentation", "gfdl")),
    ("apache", rf"apache(?:\s+software)?\s+licen[sc]e{_V}", ("apache",)),
    ("mit", r"\bmit\s+licen[sc]e", ("mit licen",)),
    ("x11", r"\bx11\s+licen[sc]e", ("x11",)),
    ("isc", r"\bisc\s+licen[sc]e", ("isc licen",)),
    ("bsd-0-clause", r"\b(?:0bsd|zero[\s-]clause\s+bsd(?:\s+licen[sc]e)?)", ("0bsd", "zero")),
    ("bsd-2-clause", r"\b(?:simplified\s+bsd|(?:2|two)[\s-]clause\s+bsd|freebsd)\s+licen[sc]e", ("bsd",)),
    ("bsd-3-clause", r"\b(?:new\s+bsd|modified\s+bsd|revised\s+bsd|(?:3|three)[\s-]clause\s+bsd)\s+licen[sc]e", ("bsd",)),
    ("bsd-4-clause", r"\b(?:original\s+bsd|(?:4|four)[\s-]clause\s+bsd)\s+licen[sc]e", ("bsd",)),
    ("bsd", r"\bbsd(?:[\s-]style)?\s+licen[sc]e", ("bsd",)),
    ("mpl", rf"(?:mozilla\s+public\s+licen[sc]e|\bmpl){_V}", ("mozilla", "mpl")),
    ("epl", rf"eclipse\s+public\s+licen[sc]e{_V}", ("eclipse",)),
    ("edl", rf"eclipse\s+distribution\s+licen[sc]e{_V}", ("eclipse",)),
    ("cddl", rf"(?:common\s+development\s+and\s+distribution\s+licen[sc]e|\bcddl){_V}", ("common development", "cddl")),
    ("cpl", rf"common\s+public\s+licen[sc]e{_V}", ("common public",)),
    ("cpal", rf"common\s+public\s+attribution\s+licen[sc]e{_V}", ("attribution",)),
    ("eupl", rf"(?:european\s+union\s+public\s+licen[sc]e|\beupl){_V}", ("european union", "eupl")),
    ("artistic", rf"(?:the\s+)?(?:perl\s+)?artistic\s+licen[sc]e{_V}", ("artistic",)),
    ("boost", rf"boost\s+software\s+licen[sc]e{_V}", ("boost",)),
    ("zlib", r"\bzlib(?:/libpng)?\s+licen[sc]e", ("zlib",)),
    ("libpng", rf"\blibpng\s+licen[sc]e{_V}", ("libpng",)),
    ("unlicense", r"\bthe\s+unlicense\b", ("unlicense",)),
    ("wtfpl", r"\bwtfpl\b|do\s+what\s+the\s+f\w+\s+you\s+want\s+to\s+public\s+licen[sc]e", ("wtfpl", "do what the")),
    ("python", rf"python\s+software\s+foundation\s+licen[sc]e{_V}|\bpsf\s+licen[sc]e", ("python", "psf")),
    ("php", rf"\bphp\s+licen[sc]e{_V}", ("php",)),
    ("ruby", r"\bruby\s+licen[sc]e", ("ruby",)),
    ("openssl", r"\bopenssl\s+licen[sc]e", ("openssl",)),
    ("postgresql", r"\bpostgresql\s+licen[sc]e", ("postgresql",)),
    ("ncsa", r"(?:university\s+of\s+illinois/)?ncsa(?:\s+open\s+source)?\s+licen[sc]e", ("ncsa",)),
    ("ofl", rf"(?:sil\s+)?open\s+font\s+licen[sc]e{_V}", ("open font",)),
    ("odbl", rf"open\s+(?:data\s+commons\s+open\s+)?database\s+licen[sc]e{_V}|\bodbl{_V.replace('?P<v>', '')}", ("open data", "open database", "odbl")),
    ("odc-by", rf"open\s+data\s+commons\s+attribution\s+licen[sc]e{_V}", ("open data",)),
    ("osl", rf"open\s+software\s+licen[sc]e{_V}", ("open software",)),
    ("afl", rf"academic\s+free\s+licen[sc]e{_V}", ("academic free",)),
    ("ms-pl", r"microsoft\s+public\s+licen[sc]e|\bms-pl\b", ("microsoft", "ms pl")),
    ("ms-rl", r"microsoft\s+reciprocal\s+licen[sc]e|\bms-rl\b", ("microsoft", "ms rl")),
    ("qpl", rf"q\s+public\s+licen[sc]e{_V}", ("q public",)),
    ("sspl", rf"server\s+side\s+public\s+licen[sc]e{_V}|\bsspl\b", ("server side", "sspl")),
    ("busl", rf"business\s+source\s+licen[sc]e{_V}", ("business source",)),
    ("elastic", rf"elastic\s+licen[sc]e{_V}", ("elastic",)),
    ("vim", r"\bvim\s+licen[sc]e", ("vim licen",)),
    ("beerware", r"beer-?ware(?:\s+licen[sc]e)?", ("beerware", "beer ware")),
    ("openrail", r"\bopenrail(?:-?[ms+]+)?(?:\s+licen[sc]e)?", ("openrail",)),
    ("cc0", rf"(?:\bcc0|creative\s+commons\s+zero){_V}", ("cc0", "commons")),
]
# Creative Commons: the elements that may follow "by", most specific first.
ELEMENTS = [("nc-nd", r"(?:nc|non-?commercial)[\s-]+(?:nd|no-?deriv\w*)"), ("nc-sa", r"(?:nc|non-?commercial)[\s-]+(?:sa|share-?alike)"),
            ("nc", r"(?:nc|non-?commercial)"), ("nd", r"(?:nd|no-?deriv\w*)"), ("sa", r"(?:sa|share-?alike)"), ("", "")]
_CC = r"(?:\bcc[\s-]+by|creative\s+commons\s+attribution)"
FAMILIES += [(f"cc-by{'-' + e if e else ''}", _CC + (r"[\s-]+" + x if x else "") + r"(?![a-z])" + _V, ("cc by", "commons"))
             for e, x in ELEMENTS]
# Ways to state a license, most binding first: name, what stands before and after it, confidence.
FORMS = [
    ("tag", r"spdx-license-identifier:\s*", r"", 1.0),
    ("terms", r"(?:re)?distribut\w*\s+under\s+the\s+terms\s+of\s+(?:the\s+)?", r"", 0.97),
    ("notice", r"licen[sc]ed\s+(?:to\s+you\s+)?under\s+(?:the\s+)?", r"", 0.95),
    ("release", r"(?:released|published|available|provided|covered)\s+under\s+(?:the\s+)?", r"", 0.9),
    ("heading", r"(?m:^)[ \t]*licen[sc]e[ \t]*:\s*(?:the\s+)?", r"", 0.9),
    ("mention", r"", r"", 0.6),
]
class Rule(NamedTuple):
    priority: int
    label: str
    pattern: re.Pattern
    keywords: tuple[str, ...]
    confidence: float


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules by priority: the hand-written signatures, then every form of every family's name, binding forms first."""
    out = [(label, pattern.replace(" ", r"\s+"), keys, sure) for label, pattern, keys, sure in SIGNATURES]
    for _, before, after, sure in FORMS:
        for label, name, keys in FAMILIES:
            out.append((label, f"{before}(?:{name}){after}", keys, sure))
    return tuple(Rule(i, label, re.compile(p), keys, sure) for i, (label, p, keys, sure) in enumerate(out))


@lru_cache(maxsize=1)
def _gates() -> dict[str, list[Rule]]:
    gates: dict[str, list[Rule]] = {}
    for rule in rules():
        for key in rule.keywords:
            gates.setdefault(key, []).append(rule)
    return gates


def plain(text: str) -> str:
    """The text that gates look at: runs of white space and hyphens are one space."""
    return " ".join(text.replace("-", " ").split())


def detect(text: str) -> list[tuple[int, int, str, float, int]]:
    """(start, end, label, confidence, priority) of the kept detections of a lower-cased text."""
    gated = plain(text)
    tried = {r.priority: r for key, held in _gates().items() if key in gated for r in held}
    found = []
    for rule in (tried[p] for p in sorted(tried)):
        for m in rule.pattern.finditer(text):
            version = m.groupdict().get("v")
            label = f"{rule.label}-{version}" if version else rule.label
            if rule.label == "spdx":  # the identifier itself
                label = " ".join(m[0].split()[1:])
            found.append((m.start(), m.end(), label, rule.confidence, rule.priority))
    found.sort(key=lambda d: (d[4], d[0] - d[1], d[0]))
    return suppress(found)


def suppress(found: list[tuple]) -> list[tuple]:
    """Detections in order of priority, without those inside one already kept.

    Kept intervals that no other kept one contains are held by start; their ends then
    rise as well, so the one before a place is the only one that can contain it.
    """
    kept, starts, ends = [], [], []
    for d in found:
        at = bisect_right(starts, d[0]) - 1
        if at >= 0 and ends[at] >= d[1]:
            continue
        kept.append(d)
        # drop outer intervals that the new one contains
        lo = bisect_left(starts, d[0])
        hi = lo
        while hi < len(ends) and ends[hi] <= d[1]:
            hi += 1
        starts[lo:hi], ends[lo:hi] = [d[0]], [d[1]]
    return kept


_WORD = rb"[0-9a-z\x80-\xff]"
_PHRASES = [(re.compile(rb"(?<!" + _WORD + rb")" + rb"[^0-9a-z\x80-\xff]+".join(p.encode().split()) + rb"(?!" + _WORD + rb")"),
             p.split()[0].encode(), label) for p, label in BASE.items()]


def scan_text(text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
    """The result columns of one text."""
    data = (text or "").encode().lower()
    inside = np.zeros(len(data) + 1, np.int8)
    inside[1:] = ALNUM[np.frombuffer(data, np.uint8)]
    starts = np.flatnonzero(np.diff(inside) == 1)
    places, base = [], set()
    for pattern, first, label in _PHRASES:
        if first in data:
            at = [m.start() for m in pattern.finditer(data)]
            if at:
                base.add(label)
                places += np.searchsorted(starts, at).tolist()
    kept = detect(data.decode())
    doubt = 1.0
    for d in kept:
        doubt *= 1 - d[3]
    return (len(starts), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | {d[2] for d in kept})), 1 - doubt)


RESULT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with the result columns."""
    @F.pandas_udf("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = pd.DataFrame([scan_text(t) for t in texts], columns=RESULT)
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    out = docs.drop(*RESULT).withColumn("_scan", scanned("text"))
    return out.select(*[c for c in docs.columns if c not in RESULT], *[F.col("_scan")[c].alias(c) for c in RESULT])


def op6_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License statements of all documents."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *RESULT)


QUERIES = {"op6_license_rules": op6_license_rules}
