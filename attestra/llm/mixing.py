"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source's target is a number of words; every document of it may be taken ``target / source_size``
times. The whole part is taken at once. The rest is a mass of words (fraction times size), and masses
are rounded in pairs: words move from one document of a pair to the other, in the direction that a
hash of the two draws, until one of them holds nothing or all of itself. The direction's odds keep
each document's expected mass, and a transfer keeps the pair's sum, so a source's words stay at its
target while its documents become whole. Blocks of about ``FAN`` documents are rounded at once, each
hands on the one document that is still fractional, and those meet in blocks of ``FAN`` again: a tree,
whose levels grow with the logarithm of the documents. The root's last document goes to the nearer
whole number, so that a source misses its target by half a document at most.

Sources by code point, null last, weigh 5, 2, 1, 5, 2, ... Targets share ``SHARE`` of all words by
weight; none goes beyond ``MOST`` times its source, and what is over is shared again.

Null texts and texts without words have size 0 and are taken with 0 words. A null source is a source,
a null doc_id an id. Rows of one doc_id, source and size are told apart by nothing that counts here:
they are rounded as one document of so many copies and then share its copies as evenly as can be.
Other columns don't come along. Without rows, or words, nothing is taken. Equal input gives equal output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import join_unique
from .store import written

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
FAN = 128  # documents, and later residuals, that are rounded in one go
SEED = 20
_PART = 4096  # equal rows that are laid out at once


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: the words of each text."""
    return docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"))


def _weighed(sources: DataFrame) -> DataFrame:
    """``sources`` (one row a source) with weight, by the place in the order of all sources; only a count for each partition is ordered as a whole."""
    order = F.col("source").asc_nulls_last()
    rows, _ = written(sources.repartitionByRange(order).sortWithinPartitions(order).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    parts = rows.groupBy("part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = parts.select("part", "first", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = (F.col("before") + F.col("at") - F.col("first")) % len(WEIGHTS)
    return rows.join(F.broadcast(before), "part").withColumn("weight", F.get(F.array(*map(F.lit, WEIGHTS)), place.cast("int"))).drop("part", "at", "first", "before")


def targets(sources: DataFrame) -> DataFrame:
    """``sources`` (source, source_size, and others) with target: words by weight, at most ``MOST`` times the source's. Each round adds sources to those at their limit until none goes beyond; the driver sees two sums a round."""
    rows, _ = written(_weighed(sources))
    limit, weight = MOST * F.col("source_size"), F.col("weight")
    total = SHARE * (rows.agg(F.sum("source_size")).first()[0] or 0)
    level, held = 0.0, -1
    while True:
        full = (weight * level > limit) if held >= 0 else F.lit(False)
        n, at_limit, free = rows.agg(F.count_if(full), F.sum(F.when(full, limit)), F.sum(F.when(~full, weight))).first()
        if n == held or not free:
            break
        level, held = (total - (at_limit or 0)) / free, n
    return rows.withColumn("target", F.least(weight * level, limit.cast("double"))).drop("weight")


def _rounded(items: Column, kind: str, done: str) -> Column:
    """struct(carry, done) of a block: its documents, largest first, each meet the one that is still fractional."""

    def meet(state: Column, x: Column) -> Column:
        c = state["carry"]
        up, down = F.least(c["size"] - c["mass"], x["mass"]), F.least(c["mass"], x["size"] - x["mass"])
        drawn = F.pmod(F.xxhash64(c["h"], x["h"], F.lit(SEED)), F.lit(1 << 52)) / F.lit(float(1 << 52))
        gains = drawn * (up + down) < down  # the carry gains at odds of what it could lose, so its expected mass stays
        carry_whole = F.when(gains, c["size"] - c["mass"] <= x["mass"]).otherwise(c["mass"] <= x["size"] - x["mass"])
        left = F.when(carry_whole, x.withField("mass", F.when(gains, x["mass"] - (c["size"] - c["mass"])).otherwise(x["mass"] + c["mass"]))).otherwise(
            c.withField("mass", F.when(gains, c["mass"] + x["mass"]).otherwise(c["mass"] - (x["size"] - x["mass"])))
        )
        whole = F.when(carry_whole, c).otherwise(x)
        one = F.when(gains == carry_whole, 1).otherwise(0)  # the carry is full, or the other one is
        return F.struct(left.cast(kind).alias("carry"), F.concat(state["done"], F.array(_settled(whole, one))).cast(done).alias("done"))

    first = F.struct(F.get(items, F.lit(0)).cast(kind).alias("carry"), F.array().cast(done).alias("done"))
    return F.aggregate(F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0))), first, meet)


def _settled(x: Column, one: Column) -> Column:
    return F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["m"].alias("m"), (x["base"] + one).alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: a row for each row of ``docs``."""
    rows, _ = written(sizes(docs).groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")))
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("s")
    sources = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("n"))
    aims, _ = written(targets(sources).withColumn("s", key))
    known = aims.select("s", "source_size", "target", F.ceil(F.col("n") / FAN).alias("n_blocks"))
    times = F.coalesce(F.col("m") * (F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0.0))
    joined = join_unique(rows.withColumn("s", key), known, "s", aims.select("s", "n")).withColumn("times", times)
    joined = joined.withColumn("base", F.floor("times")).withColumn("mass", (F.col("times") - F.col("base")) * F.col("size"))

    own = ("source", "source_size", "target")
    kind = f"struct<o:bigint,h:bigint,doc_id:{rows.schema['doc_id'].dataType.simpleString()},size:bigint,m:bigint,base:bigint,mass:double>"
    done = f"array<struct<doc_id:{rows.schema['doc_id'].dataType.simpleString()},size:bigint,m:bigint,copies:bigint>>"
    h = F.xxhash64("doc_id", "size", "s", F.lit(SEED))
    item = F.struct((-F.col("size")).alias("o"), h.alias("h"), "doc_id", "size", "m", "base", "mass").cast(kind)
    open_ = joined.where("mass > 0").select("s", *own, "n_blocks", F.pmod(h, F.greatest("n_blocks", F.lit(1))).alias("block"), item.alias("item"))
    settled = joined.where("mass <= 0").select(*own, "doc_id", "size", "m", F.col("base").alias("copies"))
    most = aims.agg(F.coalesce(F.max(F.ceil(F.col("n") / FAN)), F.lit(0))).first()[0]
    while True:
        blocks = open_.groupBy("s", *own, "n_blocks", "block").agg(F.sort_array(F.collect_list("item")).alias("items"))
        level, _ = written(blocks.select("s", *own, "n_blocks", "block", _rounded(F.col("items"), kind, done).alias("r")).select("s", *own, "n_blocks", "block", "r.*"))
        last = F.array(_settled(F.col("carry"), F.when(2 * F.col("carry.mass") >= F.col("carry.size"), 1).otherwise(0))).cast(done)
        every = F.concat("done", F.when(F.col("n_blocks") <= 1, last).otherwise(F.array().cast(done)))
        settled = settled.unionByName(level.select(*own, F.inline(every)))
        if most <= 1:
            break
        most = -(-most // FAN)
        open_ = level.where("n_blocks > 1").select("s", *own, F.ceil(F.col("n_blocks") / FAN).alias("n_blocks"), F.floor(F.col("block") / FAN).alias("block"), F.col("carry").alias("item"))

    parts = settled.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / _PART))).alias("part"))
    single = parts.select("*", F.explode(F.sequence(F.col("part") * _PART, F.least((F.col("part") + 1) * _PART, "m") - 1)).alias("i"))
    copies = F.floor(F.col("copies") / F.col("m")) + F.when(F.col("i") < F.col("copies") % F.col("m"), 1).otherwise(0)
    out = single.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"))
    return out.withColumn("taken", F.col("size") * F.col("copies"))
