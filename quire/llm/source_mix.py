"""Mixing sources to target weights (operator 8), DataFrame functions only.

Every source is one stream of words: its documents in the order of a hash, cut
into blocks of ``block`` words (its last may be shorter).  The mix is a line of block
slots on which each source holds a stretch as long as its target; a
pseudorandom permutation of the line deals the slots to output shards of
``shard_blocks`` slots.  A shard's source counts are thereby multinomial draws
conditioned on the corpus totals (multivariate hypergeometric): they vary from shard to shard, while every
source's total is its target to within a block.  The n-th slot of a source
takes, in pass ``n div blocks``, the block at a pseudorandom permutation of ``n mod blocks`` (one per
source and pass); blocks are joined by index.  Passes never exceed ``cap``, so no
document is taken more than ``cap`` times.

Targets: sources are ordered by code point, null last, and weigh ``1, 2, 3, 1, ...``; together they
share all words; a target stops at ``cap`` times its source's size and the excess is
shared anew by weight (water filling, in closed form over the sources ordered by size per weight).

Permutations are an affine step and swap-or-not rounds, which act on any
length; all randomness is a hash of the seed, so reruns agree.

Defined results: a null or wordless text has size 0 and takes 0; a null source is a
source of its own; repeated rows are rows of their own; null ids are ordinary
values; an empty table gives no rows; a corpus without words takes nothing;
other columns are kept, unless they are named like a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import materialize, parts_for, running, table

WORDS = r"[^\x20\x09-\x0D]+"
# Primes; any length below 10**18 is coprime to one of them.
PRIMES = (1_000_003, 1_000_033, 1_000_037)
ROUNDS = 6


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def permute(df: DataFrame, x: str, length: str, key: list[str], seed: int, out: str) -> DataFrame:
    """``out``: the image of column ``x`` under a permutation of ``0 .. length - 1``, one per key."""
    n = F.col(length)
    step = F.when(n % PRIMES[0] != 0, F.lit(PRIMES[0])).when(n % PRIMES[1] != 0, F.lit(PRIMES[1])).otherwise(
        F.lit(PRIMES[2])).cast("long")
    df = df.withColumn(out, F.pmod(F.col(x) * step + F.pmod(F.xxhash64(F.lit(seed), *key), n), n))
    for r in range(ROUNDS):
        # A round pairs y with (key - y) and swaps the pair or not by a bit of the pair.
        df = df.withColumn("_to", F.pmod(F.pmod(F.xxhash64(F.lit(seed), F.lit(r), *key), n) - F.col(out), n))
        bit = F.xxhash64(F.lit(seed), F.lit(~r), F.greatest(out, "_to"), *key).bitwiseAND(F.lit(1).cast("long"))
        df = df.withColumn(out, F.when(bit == 1, F.col("_to")).otherwise(F.col(out)))
    return df.drop("_to")


def targets(sizes: DataFrame, cap: int = 3) -> DataFrame:
    """``src, source, source_size, target`` from ``source, source_size``.

    One row per source: a small table, ordered in one task.
    """
    first = Window.orderBy(F.col("source").isNull(), "source")
    s = sizes.withColumn("src", F.row_number().over(first).cast("long") - 1)
    s = s.withColumn("weight", F.pmod("src", F.lit(3)) + 1).withColumn("limit", cap * F.col("source_size"))
    by = Window.orderBy(F.col("limit") / F.col("weight"), "src")
    earlier = by.rowsBetween(Window.unboundedPreceding, -1)
    rest = by.rowsBetween(0, Window.unboundedFollowing)
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    room = F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(earlier), F.lit(0))
    s = s.withColumn("level", room / F.sum("weight").over(rest))
    # In this order every source is capped up to the first that is not; its level holds for all after it.
    s = s.withColumn("free", F.col("limit") > F.col("level") * F.col("weight"))
    s = s.withColumn("share", F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(whole))
    target = F.when(F.col("free"), F.col("share") * F.col("weight")).otherwise(F.col("limit")).cast("double")
    return s.select("src", "source", "source_size", target.alias("target"))


class Mix:
    """The parts of one mix; each is a DataFrame.

    ``sources``  src, source, source_size, target, blocks, slots, slot_end
    ``streams``  the rows of ``docs`` with size, src, target and start, their first word in the stream
    ``slots``    shard, slot, src, pass, block: every slot of the mix and the block it takes
    """

    def __init__(self, docs: DataFrame, block: int = 32, shard_blocks: int = 4096, cap: int = 3, seed: int = 8,
                 narrow: bool = False):
        """``narrow``: the streams carry no texts, which only their sizes and order need."""
        self.block, self.cap, self.seed = block, cap, seed
        own = ("size", "src", "source_size", "target", "start", "taken")
        sized = docs.drop(*own).withColumn("size", word_count(F.col("text"))).withColumn(
            "_order", F.xxhash64(F.lit(seed), "doc_id", "text"))
        sized = materialize(sized.drop("text") if narrow else sized, "sized")
        sizes = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows")),
                            "sources")
        goal = targets(sizes.drop("_rows"), cap)
        blocks = F.ceil(F.col("source_size") / block).cast("long")
        wanted = F.round(F.col("target") * blocks / F.greatest("source_size", F.lit(1))).cast("long")
        goal = goal.withColumn("blocks", blocks).withColumn("slots", F.least(cap * blocks, wanted))
        upto = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0)
        self.sources = materialize(goal.withColumn("slot_end", F.sum("slots").over(upto)), "sources")
        rows, total = sizes.agg(F.sum("_rows")).first()[0] or 0, self.sources.agg(F.sum("slots")).first()[0] or 0

        named = self.sources.select(F.col("source").alias("_name"), "src", "source_size", "target")
        placed = sized.join(named, F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
        self.streams = materialize(
            running(placed, ["src"], ["_order", "doc_id", "size"],
                    F.pmod("_order", F.lit(parts_for(rows, 4096))), F.col("size"), "start").drop("_order"), "streams")

        # The stretches of the line in pieces, so that no task writes a whole source.
        piece = 1 << 14
        lo = F.col("slot_end") - F.col("slots")
        line = self.sources.where("slots > 0").select("src", "blocks", "slots", lo.alias("lo")).withColumn(
            "part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / piece).cast("long"))))
        n = F.explode(F.sequence(F.col("part") * piece, F.least((F.col("part") + 1) * piece, "slots") - 1))
        line = line.repartition("src", "part").select("src", "blocks", "lo", n.alias("n"))
        line = line.withColumn("at", F.col("lo") + F.col("n")).withColumn("all", F.lit(max(total, 1)).cast("long"))
        line = permute(line, "at", "all", [], seed, "slot")
        line = line.withColumn("pass", F.floor(F.col("n") / F.col("blocks")).cast("long")).withColumn(
            "index", F.col("n") % F.col("blocks"))
        line = permute(line, "index", "blocks", ["src", "pass"], seed + 1, "block")
        line = line.select(F.floor(F.col("slot") / shard_blocks).cast("long").alias("shard"), "slot", "src", "pass", "block")
        # Written: a filter pushed below the rounds would repeat them within itself.
        self.slots = materialize(line, "slots")

    def draws(self) -> DataFrame:
        """``shard, src, draws``: the source counts of each output shard."""
        return self.slots.groupBy("shard", "src").agg(F.count("*").alias("draws"))

    def pieces(self) -> DataFrame:
        """``src, block, start, first_word, words``: the part of each block that a document fills."""
        end = F.col("start") + F.col("size")
        spread = F.sequence(F.floor(F.col("start") / self.block).cast("long"), F.floor((end - 1) / self.block).cast("long"))
        held = self.streams.where("size > 0").select("src", "start", "size", F.explode(spread).alias("block"))
        lo = F.greatest("start", F.col("block") * self.block)
        hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * self.block)
        return held.select("src", "block", "start", (lo - F.col("start")).alias("first_word"), (hi - lo).alias("words"))

    def taken(self) -> DataFrame:
        """The streams with ``taken``: the words of each row that the mix takes, repeats counted."""
        times = self.slots.groupBy("src", "block").agg(F.count("*").alias("times"))
        # Both sides grow with the corpus; a size estimate does not see the exploded rows, so it must not choose.
        took = self.pieces().hint("merge").join(times, ["src", "block"]).groupBy("src", "start").agg(
            F.sum(F.col("words") * F.col("times")).alias("taken"))
        took = took.select(F.col("src").alias("_src"), F.col("start").alias("_start"), "taken")
        on = (F.col("src") == F.col("_src")) & (F.col("start") == F.col("_start")) & (F.col("size") > 0)
        return self.streams.join(took, on, "left").drop("_src", "_start").withColumn(
            "taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its words are taken on average.

    The fraction of a pass left over becomes a whole copy with that
    probability, by a hash of the row, so a source keeps its target in expectation.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "source", "text")]
    packed = docs.select("doc_id", "source", "text", F.struct(F.lit(0).alias("_"), *others).alias("_others"))
    mix = Mix(packed, **options)
    times = F.col("taken") / F.greatest("size", F.lit(1))
    coin = F.pmod(F.xxhash64(F.lit(mix.seed), F.lit("copies"), "src", "start"), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor(times + coin).cast("int")
    out = mix.taken().withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies)))
    return out.select(*[F.col(c) if c not in others else F.col("_others").getField(c).alias(c) for c in docs.columns])


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return Mix(docs, narrow=True).taken().select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op8_source_mix": op8_source_mix}
