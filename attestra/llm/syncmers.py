"""Document fingerprints from closed syncmers, with DataFrame functions only.

A text is read as short tokens: each word in runs of up to ``TOKEN`` characters from its start, with
``K - 1`` marks before the first. A k-mer is ``K`` tokens in a row; its inner substrings are its runs
of ``S`` tokens. It is an anchor if its smallest inner hash lies at its first or last place, which
depends on the k-mer alone: what surrounds it doesn't matter, so equal passages have equal anchors
(two thirds of their k-mers) wherever they stand.

A fingerprint holds all distinct anchor hashes (32 bits), each with its first place (31 bits, in
tokens). Two fingerprints are matched by position: those anchors count as matched that both have and
that moved by about the same distance (the median of the shared ones, give or take ``SLACK``).
Likeness is 2 m / (n + m) for m matched of n distinct anchors of both together. Work and size grow
with the length of the texts (sorting, but no comparison of all pairs of anchors).

Defined results: null and empty texts have no anchors and an empty fingerprint; two empty ones are
alike (1), an empty and another are not (0); equal texts have equal fingerprints and likeness 1; equal
inner hashes count as smallest at either place, and of an even number of moves the larger middle one
counts; repeated rows give equal rows; a very long text's tokens and anchors are held at once, in memory
of about sixty bytes a token, and places go up to 2**31 tokens; an empty table gives an empty result;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import checkpointed

TOKEN, K, S = 4, 4, 2
SLACK = 8


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with ``name``: an array of longs, hash << 32 | place, in order of the signed hash. Its steps are columns of their own, so each is computed once."""
    t, s, a, o = (f"{name}_{x}" for x in ("tokens", "inner", "anchors", "order"))
    marks = [F.lit(-i - 1).cast("long") for i in range(K - 1)]
    hashed = F.transform(F.regexp_extract_all(text, F.lit(rf"[^\x20\x09-\x0D]{{1,{TOKEN}}}"), F.lit(0)), lambda x: F.xxhash64(x))
    pair = F.zip_with(F.slice(t, F.lit(1), F.size(t) - 1), F.slice(t, F.lit(2), F.size(t) - 1), lambda x, y: F.xxhash64(x, y))

    def anchor(first: Column, i: Column) -> Column:
        middle, last = F.get(F.col(s), i + 1), F.get(F.col(s), i + 2)
        packed = F.shiftleft(F.xxhash64(first, last), 32).bitwiseOR(i.cast("long"))
        return F.when(~((middle < first) & (middle < last)), packed)

    fresh = lambda x, i: (i == 0) | (F.shiftright(x, 32) != F.shiftright(F.get(F.col(o), i - 1), 32))
    return (
        df.withColumn(t, F.concat(F.array(*marks), hashed))
        .withColumn(s, pair)
        .withColumn(a, F.transform(F.slice(s, F.lit(1), F.size(s) - (K - S)), anchor))
        .withColumn(o, F.sort_array(F.array_compact(a)))
        .withColumn(name, F.filter(o, fresh))
        .drop(t, s, a, o)
    )


def as_text(fingerprint: str) -> Column:
    """Sixteen hexadecimal digits an anchor."""
    return F.lower(F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def with_likeness(df: DataFrame, left: str, right: str, name: str) -> DataFrame:
    """``df`` with ``name``: the likeness of two fingerprint columns, 0 to 1."""
    u, d, g = (f"{name}_{x}" for x in ("all", "moves", "agree"))
    side = 1 << 31  # marks the right one's anchors, which so follow the left one's of the same hash
    place = lambda x: x.bitwiseAND(F.lit(side - 1))

    def move(x: Column, i: Column) -> Column:
        before = F.get(F.col(u), i - 1)
        return F.when(F.shiftright(x, 32) == F.shiftright(before, 32), place(x) - place(before))

    middle = F.get(F.col(d), F.floor(F.size(d) / 2).cast("int"))
    distinct = F.size(u) - F.size(d)
    return (
        df.withColumn(u, F.sort_array(F.concat(F.col(left), F.transform(right, lambda x: x.bitwiseOR(F.lit(side))))))
        .withColumn(d, F.sort_array(F.array_compact(F.transform(u, move))))
        .withColumn(g, F.size(F.filter(d, lambda x: F.abs(x - middle) <= SLACK)))
        .withColumn(name, F.when(F.size(u) == 0, F.lit(1.0)).when(F.size(d) == 0, F.lit(0.0)).otherwise(2 * F.col(g) / (distinct + F.col(g))))
        .drop(u, d, g)
    )


def predecessors(ids: DataFrame) -> DataFrame:
    """For each row of distinct keys: the key before in order; before the first comes the last.

    The keys are dealt into ranges; each range orders its own, and one row a range (as many as there
    are shuffle partitions) tells the next range where the one before ended. No step orders all rows at once.
    """
    ranged = checkpointed(ids.repartitionByRange("key").select("key", F.spark_partition_id().alias("range")))
    mine = F.struct("key")
    last = ranged.groupBy("range").agg(F.max(mine).alias("last"))
    edge = last.select("range", F.coalesce(F.lag("last").over(W.orderBy("range")), F.last("last").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("edge"))
    inside = ranged.withColumn("before", F.lag(mine).over(W.partitionBy("range").orderBy("key")))
    return inside.join(F.broadcast(edge), "range").select("key", F.coalesce("before", "edge").alias("before")).select("key", F.col("before.key").alias("before_key"))


def compare_edits(docs: DataFrame) -> DataFrame:
    """Every row with its text, its edited text (the last quarter replaced by the start of the next document), both fingerprints and the likenesses.

    The next document is that of the next larger doc_id (nulls first; after the last the first). Where
    an id occurs more than once, the smallest text stands for it as the next document. Texts are
    shuffled by id and go to the row before; fingerprints, which are larger than compressed texts,
    are made of the texts there and never shuffled.
    """
    whole = lambda key: (F.coalesce(key, F.lit(0)).alias("k"), F.col(key).isNull().alias("none"))  # noqa: E731  plain keys, so that grouping and join share one shuffle
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), *whole("doc_id"))
    before = predecessors(docs.select(F.col("doc_id").alias("key")).distinct())
    keyed = before.select(*whole("key"), "before_key")
    nexts = rows.join(keyed, ["k", "none"]).select(*whole("before_key"), "text").groupBy("k", "none").agg(F.min("text").alias("next"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    both = (
        rows.join(nexts, ["k", "none"])
        .withColumn("n_chars", F.char_length("text").cast("long"))
        .withColumn("edited", F.concat(F.left("text", F.col("n_chars").cast("int") - quarter), F.left("next", quarter)))
        .select(F.when(~F.col("none"), F.col("k")).alias("doc_id"), "text", "n_chars", "edited", "next")
    )
    printed = with_fingerprint(with_fingerprint(with_fingerprint(both, "text", "print"), "edited", "edited_print"), "next", "next_print")
    return with_likeness(with_likeness(printed, "print", "edited_print", "near_edited"), "print", "next_print", "near_next").drop("next")
