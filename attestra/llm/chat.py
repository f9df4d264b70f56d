"""Chat formatting in budgeted windows, with DataFrame functions only.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``. Backslashes and the opening of a control
string inside roles and texts are escaped with a backslash, so a text can never end its own turn and
everything can be read back.

Prefix sums of the turns' tokens cut a conversation at turns into spans that fit a window's room: the
budget less the system turn and less what is set aside for history, ``HISTORY_TOKENS``, or so much less
of it that ``LEAST_ROOM`` is left. A turn that would fill over half the room stands alone; the others
are dealt by the place where they begin, on a grid as wide as the room less the conversation's largest
such turn, which is the most that the last turn of a span can stand out. Each span becomes a window:
the conversation's first system turn, if an earlier window owns it, then up to ``HISTORY_TURNS`` turns
before the span, as far as they fit ``HISTORY_TOKENS`` and the budget, then its own turns. The loss mask
covers the assistant texts of a window's own turns only, so a repeated turn is no target again.

A window of several own turns, or with history, is never over the budget. Turns are never cut and the
system turn is never left out, so one turn that is too long, alone or with the system turn, is over it;
``tokens`` tells such windows.

Defined results: null texts and roles are empty ones; turns are ordered by turn, role and text, null
turns first; repeated rows are turns of their own; rows with a null conv_id form one conversation;
a very long text stays one turn; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, STOP = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY_TURNS, HISTORY_TOKENS, LEAST_ROOM = 2048, 2, 384, 256
_TURN = r"(?s)<\|im_start\|>((?:[^\\\n]|\\.)*+)\n(.*?)<\|im_end\|>\n"


def escape(text: Column, header: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("\\\n")) if header else out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def tokens(text: Column) -> Column:
    """An estimate without a vocabulary: four letters or digits, or one sign, a token; four more for the turn's marks."""
    return (F.regexp_count(text, F.lit(r"[\p{L}\p{N}]{1,4}|[^\s\p{L}\p{N}]")) + 4).cast("long")


def windows(conversations: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """conv_id, window, text, n_context (turns at its start that other windows own), tokens (as estimated, with the system turn and history) and loss (spans of code points)."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    system = F.when(F.col("role") == "system", F.struct(F.col("text").alias("t"), F.col("size").alias("n")))
    cut = (
        turns.withColumn("size", tokens(F.col("text")))
        .withColumn("rn", F.row_number().over(order))
        .withColumn("before", F.sum("size").over(so_far) - F.col("size"))
        .withColumn("system", F.first(system, ignorenulls=True).over(so_far))
        .withColumn("system_rn", F.min(F.when(F.col("role") == "system", F.col("rn"))).over(so_far))
        .withColumn("left", F.lit(budget) - F.coalesce(F.col("system.n"), F.lit(0)))
        .withColumn("room", F.col("left") - F.greatest(F.lit(0), F.least(F.lit(history_tokens), F.col("left") - LEAST_ROOM)))
        .withColumn("large", F.col("size") * 2 > F.col("room"))
        .withColumn("most", F.coalesce(F.max(F.when(~F.col("large"), F.col("size"))).over(W.partitionBy("conv_id")), F.lit(0)))
        .withColumn("grid", F.greatest(F.col("room") - F.col("most"), F.col("room") / 2, F.lit(1)))  # the room shrinks at the system turn, so a turn before it may be the largest
        .withColumn("at", F.struct(F.floor(F.col("before") / F.col("grid")).alias("part"), F.when(F.col("large"), F.col("rn")).alias("alone")))
        .withColumn("opens", F.coalesce(F.col("at") != F.lag("at").over(order), F.lit(True)))
        .withColumn("span", F.sum(F.col("opens").cast("long")).over(so_far))
        .withColumn("lead_size", F.when(F.col("opens") & (F.col("system_rn") < F.col("rn")), F.col("system.n")))
    )
    # What the next window holds in any case, and so how much of this one's end it can repeat.
    taken = F.sum("size").over(W.partitionBy("conv_id", "span")) + F.coalesce(F.max("lead_size").over(W.partitionBy("conv_id", "span")), F.lit(0))
    cut = cut.withColumn("taken", taken).withColumn("fits", F.least(F.lit(history_tokens), F.lit(budget) - F.first("taken").over(W.partitionBy("conv_id").orderBy("span").rangeBetween(1, 1))))
    backwards = W.partitionBy("conv_id", "span").orderBy(F.col("rn").desc())
    leads = F.col("rn") == F.coalesce("system_rn", F.lit(0))
    again = (F.row_number().over(backwards) <= history_turns) & (F.sum("size").over(backwards.rowsBetween(W.unboundedPreceding, 0)) <= F.coalesce("fits", F.lit(0))) & ~leads
    head = F.concat(F.lit(START), escape(F.col("role"), True), F.lit("\n"))
    rows = cut.withColumn("again", again).select(
        "conv_id",
        "rn",
        F.when(F.col("opens") & (F.col("system_rn") < F.col("rn")), F.concat(F.lit(f"{START}system\n"), escape(F.col("system.t")), F.lit(f"{STOP}\n"))).alias("lead"),
        F.col("lead_size"),
        F.col("size"),
        (F.col("role") == "assistant").alias("target"),
        head.alias("head"),
        escape(F.col("text")).alias("body"),
        F.explode(F.when(F.col("again"), F.array("span", F.col("span") + 1)).otherwise(F.array("span"))).alias("window"),
        "span",
    )
    grouped = (
        rows.withColumn("own", F.col("span") == F.col("window"))
        .groupBy("conv_id", "window")
        .agg(F.array_sort(F.collect_list(F.struct("rn", "own", "target", "head", "body"))).alias("turns"), F.max("lead").alias("lead"), (F.sum("size") + F.coalesce(F.max(F.when(F.col("own"), F.col("lead_size"))), F.lit(0))).alias("tokens"))
        .where(F.exists("turns", lambda t: t["own"]))
    )
    start = F.struct(F.char_length(F.coalesce("lead", F.lit(""))).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(done: Column, t: Column) -> Column:
        begin = done["at"] + F.char_length(t["head"])
        end = begin + F.char_length(t["body"])
        span = F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end"))
        return F.struct((end + len(STOP) + 1).cast("long").alias("at"), F.when(t["own"] & t["target"], F.concat(done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans"))

    return grouped.select(
        "conv_id",
        "window",
        F.concat(F.coalesce("lead", F.lit("")), F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(f"{STOP}\n"))), "")).alias("text"),
        (F.col("lead").isNotNull().cast("int") + F.size(F.filter("turns", lambda t: ~t["own"]))).alias("n_context"),
        "tokens",
        F.aggregate("turns", start, step, lambda done: done["spans"]).alias("loss"),
    )


def read_back(found: DataFrame) -> DataFrame:
    """conv_id, window, turns (role and text of the window's own turns) and targets (texts under the mask), unescaped."""
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(_TURN), F.lit(1)).alias("role"), F.regexp_extract_all("text", F.lit(_TURN), F.lit(2)).alias("text"))
    own = F.filter(both, lambda _, i: i >= F.col("n_context"))
    return found.select(
        "conv_id",
        "window",
        F.transform(own, lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text"))).alias("turns"),
        F.transform("loss", lambda s: unescape(F.substring("text", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))).alias("targets"),
        F.char_length("text").cast("long").alias("formatted_chars"),
    )


def digest(found: DataFrame) -> DataFrame:
    """One row a conversation: its turns and targets as they are read back from its windows. A conversation's text has to fit a task here, and only here."""
    parts = read_back(found).select(
        "conv_id",
        "window",
        "formatted_chars",
        F.size("turns").cast("long").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        F.array_join("targets", "").alias("targets"),
    )
    whole = parts.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "turns", "targets"))).alias("all"), F.sum("formatted_chars").alias("formatted_chars")
    )
    turns, targets = F.array_join(F.col("all.turns"), ""), F.array_join(F.col("all.targets"), "")
    return whole.select("conv_id", "n_turns", F.sha2(turns, 256).alias("turns_sha256"), F.char_length(targets).cast("long").alias("loss_chars"), F.sha2(targets, 256).alias("loss_sha256"), "formatted_chars")
