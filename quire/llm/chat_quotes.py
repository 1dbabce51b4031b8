r"""Chat formatting by quotation linking (operator 4).

A line that begins with ``>`` marks is quoted; the number of marks (white space
between them allowed) is its level.  Consecutive lines of one level are a passage, whatever
empty lines and line breaks it has.  A passage is normalised (marks off, white space to one space,
trimmed, lower case) and cut into units: its runs of ``WINDOW`` words, its sentences and its lines.  So a
quote is found if it was wrapped anew or quotes a part, as long as it shares a unit.  The units of quoted
passages and of what messages wrote themselves are hashed.  A quoted unit belongs to the message that wrote it first:
in the same conversation at an earlier turn, else in any other conversation.  A message
replies to the message that owns most of its quoted units of the lowest level that has
an owner (ties: the earliest); deeper levels are kept as links too.

``linked_messages`` returns one row per message without its quoted lines (they are given in ``quoted``) and
without the attribution lines before them (``... wrote:``), with the message it
replies to, its depth in the tree of replies, and its position in the
conversation.  A message stands after the one it replies to: an owner in the
same conversation has a smaller turn, and positions follow turns.

Nothing gathers a conversation or a line's users: owners are partially aggregated
minima, lines are joined to them, positions come from bounded parts, and depths
from pointer doubling over the links alone.

Defined results: null or empty texts write and quote nothing and stay as empty messages;
empty lines are nobody's; a null ``conv_id`` is a conversation of its own, a null turn comes last and owns
nothing within its conversation; repeated rows are messages with the same
place in the tree; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import materialize, mix64, running, table, word_hashes

WINDOW = 6
_MARKED = re.compile(r"[ \t]*(>[> \t]*)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[\u3002\uff01\uff1f])\s*")
MARKS = r"^[ \t]*(>[> \t]*)"


def level_of(line: Column) -> Column:
    """Number of quote marks at the beginning of a line."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), r"[^>]", ""))


def parsed(messages: DataFrame) -> DataFrame:
    """Messages with ``lines``: level and text, and ``own``, the text without quotes."""
    lines = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"), "\n")
    out = messages.withColumn("_raw", lines).withColumn(
        "lines", F.transform("_raw", lambda x: F.struct(level_of(x).alias("level"), x.alias("raw"))))
    # an attribution goes with the quoted line that follows it
    kept = F.filter(F.transform(F.col("lines"), lambda x, i: F.struct(
        x["raw"].alias("raw"), ((x["level"] == 0) & ~(x["raw"].rlike(r"(?i)\bwrote:\s*$") & (F.coalesce(
            F.get(F.col("lines"), i + 1)["level"], F.lit(0)) > 0))).alias("stays"))), lambda x: x["stays"])
    own = F.array_join(F.transform(kept, lambda x: x["raw"]), "\n")
    own = F.regexp_replace(F.regexp_replace(own, r"^\s+|\s+$", ""), r"\n{3,}", "\n\n")
    return out.withColumn("own", own).drop("_raw")


def passages(text: str) -> list[tuple[int, list[str]]]:
    """(level, normalised lines) of every passage in order; empty lines are left out."""
    out: list[tuple[int, list[str]]] = []
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        m = _MARKED.match(line)
        norm = " ".join(line[m.end() if m else 0 :].lower().split())
        level = m[1].count(">") if m else 0
        if norm and out and out[-1][0] == level:
            out[-1][1].append(norm)
        elif norm:
            out.append((level, [norm]))
    return out


def unit_hashes(lines: list[str]) -> dict[int, bool]:
    """Hashes of the units of a passage, and whether a unit has ``WINDOW`` words."""
    whole = " ".join(lines)
    out = {int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little", signed=True): len(x.split()) >= WINDOW
           for x in {*lines, *_SENTENCE.split(whole)} if x}
    words = word_hashes(whole.encode())[2]
    if len(words) >= WINDOW:
        runs = np.zeros(len(words) - WINDOW + 1, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(WINDOW):
                runs = mix64(runs * np.uint64(0x9E3779B97F4A7C15) + words[j : len(runs) + j])
        out.update(dict.fromkeys(runs.view(np.int64).tolist(), True))
    return out


def units(messages: DataFrame, quoted: bool) -> DataFrame:
    """``conv_id, turn, level, h, long``: the units a message quotes, or those it wrote itself."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 64):
                rows, some = [], pdf.iloc[a : a + 64]
                for i, text in enumerate(some["text"]):
                    found = {(level, h, long) for level, lines in passages(text) if (level > 0) == quoted
                             for h, long in unit_hashes(lines).items()}
                    rows += [(i, *unit) for unit in found]
                at = np.array([r[0] for r in rows], np.int64)
                yield pd.DataFrame({
                    "conv_id": some["conv_id"].take(at).array, "turn": some["turn"].take(at).array,
                    "level": np.array([r[1] for r in rows], np.int32), "h": np.array([r[2] for r in rows], np.int64),
                    "long": np.array([r[3] for r in rows], bool)})

    some = messages.where("text is not null")
    if quoted:  # only messages with a mark come to Python
        some = some.where(F.col("text").rlike(r"(^|[\r\n])[ \t]*>"))
    # ids are strings in Python: pandas turns whole numbers beside a null into floats
    keyed = some.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("string").alias("turn"), "text")
    out = keyed.mapInPandas(run, "conv_id string, turn string, level int, h long, long boolean")
    return out.withColumns({c: F.col(c).cast("long") for c in ("conv_id", "turn")})


def quote_links(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, level, to_conv, to_turn, n_units``: quoted units by the message that wrote them first."""
    # repeated rows of a message quote alike
    quoted = materialize(units(messages, True).distinct(), "quoted")
    if quoted.isEmpty():
        none = [F.lit(None).cast("long").alias(c) for c in ("to_conv", "to_turn", "n_units")]
        return quoted.select("conv_id", "turn", "level", *none)
    asked = quoted.select("h").distinct()
    written = units(messages.where("turn is not null and conv_id is not null"), False).join(asked, "h", "left_semi")
    here = materialize(written.groupBy("conv_id", "h").agg(F.min("turn").alias("here")), "written")
    # the earliest writer of all; for a message of the same conversation there is no earlier one elsewhere
    first = here.groupBy("h").agg(F.min(F.struct("conv_id", F.col("here").alias("turn"))).alias("first"))
    found = quoted.join(here, ["conv_id", "h"], "left").join(first, "h", "left")
    inside = F.col("here") < F.col("turn")
    outer = F.when(F.col("long") & (F.col("first.conv_id") < F.col("conv_id")), F.col("first"))
    found = found.select(
        "conv_id", "turn", "level", F.when(inside, F.struct(F.col("conv_id"), F.col("here").alias("turn"))).otherwise(outer).alias("to"))
    return found.where("to is not null").groupBy(
        "conv_id", "turn", "level", F.col("to.conv_id").alias("to_conv"), F.col("to.turn").alias("to_turn")).agg(
        F.count("*").alias("n_units"))


def depths(replies: DataFrame) -> DataFrame:
    """``conv_id, turn, depth`` of messages that reply to others, by pointer doubling.

    ``replies``: conv_id, turn, to_conv, to_turn, one row per message; a message replies to an earlier turn or an
    earlier conversation, so every chain ends.
    """
    cur = replies.select("conv_id", "turn", "to_conv", "to_turn", F.lit(1).cast("long").alias("depth"))
    cur = materialize(cur, "depth")
    while True:
        nxt = cur.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("to_conv").alias("to_c"),
                         F.col("to_turn").alias("to_t"), F.col("depth").alias("more"))
        if nxt.join(cur, (F.col("c") == F.col("to_conv")) & (F.col("t") == F.col("to_turn")), "left_semi").isEmpty():
            break
        grown = cur.join(nxt, (F.col("to_conv") == F.col("c")) & (F.col("to_turn") == F.col("t")), "left")
        cur = materialize(grown.select(
            "conv_id", "turn", F.when(F.col("c").isNotNull(), F.col("to_c")).otherwise(F.col("to_conv")).alias("to_conv"),
            F.when(F.col("c").isNotNull(), F.col("to_t")).otherwise(F.col("to_turn")).alias("to_turn"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "depth")
    return cur.select("conv_id", "turn", "depth")


def linked_messages(messages: DataFrame, part_turns: int = 1024) -> DataFrame:
    """``conv_id, turn, role, text, quoted, n_quoted, max_level, reply_to_conv, reply_to_turn, depth, position``."""
    named = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    split = parsed(named)
    links = materialize(quote_links(named), "links")
    best = F.min(F.struct("level", (-F.col("n_units")).alias("n"), "to_conv", "to_turn")).alias("b")
    replies = materialize(links.where("turn is not null and conv_id is not null").groupBy("conv_id", "turn").agg(best).select(
        "conv_id", "turn", F.col("b.to_conv").alias("to_conv"), F.col("b.to_turn").alias("to_turn")), "replies")
    deep = depths(replies)
    tree = replies.join(deep, ["conv_id", "turn"])
    rows = split.select(
        "conv_id", "turn", "role", F.col("own").alias("text"),
        F.array_join(F.transform(F.filter("lines", lambda x: x["level"] > 0), lambda x: x["raw"]), "\n").alias("quoted"),
        F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("long").alias("n_quoted"),
        F.array_max(F.transform("lines", lambda x: x["level"])).alias("max_level"))
    rows = rows.join(tree, ["conv_id", "turn"], "left").withColumn("depth", F.coalesce("depth", F.lit(0).cast("long")))
    rows = rows.withColumn("_conv", F.coalesce("conv_id", F.lit(0))).withColumn("_null", F.col("conv_id").isNull())
    rows = rows.withColumn("_late", F.col("turn").isNull())
    part = F.when(F.col("_late"), F.lit(1 << 62)).otherwise(F.floor(F.col("turn") / part_turns)).cast("long")
    rows = running(rows, ["_conv", "_null"], ["turn", "role", F.xxhash64("text")], part, F.lit(1), "position")
    return rows.select("conv_id", "turn", "role", "text", "quoted", "n_quoted", "max_level", F.col("to_conv").alias("reply_to_conv"),
                       F.col("to_turn").alias("reply_to_turn"), "depth", "position")


def op4_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations without quotes, linked and in reply order."""
    return linked_messages(table(spark, sf_dir, "conversations"))


QUERIES = {"op4_chat_quotes": op4_chat_quotes}
