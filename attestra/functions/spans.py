"""Character spans of evidence, from its own span or from its locator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOCATOR = r"(?s)^(.+)#(?:chunk:([0-9]{1,9})@)?chars:([0-9]{1,9})-([0-9]{1,9})$"


def parsed_span(locator: Column) -> Column:
    """locator, chunk_index, start, end, quote, typed from ``source#[chunk:N@]chars:S-E`` (the last ``#`` counts); NULL if it doesn't parse or ends before it starts."""
    part = lambda k: F.regexp_extract(locator, _LOCATOR, k)
    start, end = part(3).try_cast("int"), part(4).try_cast("int")
    span = F.struct(
        part(1).alias("locator"), F.nullif(part(2), F.lit("")).try_cast("int").alias("chunk_index"), start.alias("start"), end.alias("end"), F.lit(None).cast("string").alias("quote"), F.lit(False).alias("typed")
    )
    return F.when(locator.rlike(_LOCATOR) & (end >= start), span)


def evidence_span(locator: Column, span: Column) -> Column:
    """The evidence's own span if it is sound (typed), with the locator's source and chunk where that parses; else the locator's."""
    parsed = parsed_span(locator)
    typed = F.struct(
        F.coalesce(parsed["locator"], locator).alias("locator"), parsed["chunk_index"].alias("chunk_index"), span["start"].alias("start"), span["end"].alias("end"), span["quote"].alias("quote"), F.lit(True).alias("typed")
    )
    return F.when((span["start"] >= 0) & (span["end"] >= span["start"]), typed).otherwise(parsed)


def span_length(span: Column) -> Column:
    return span["end"] - span["start"]


def evidence_text(availability: Column, content: Column, span: Column) -> Column:
    """What a verifier may read of a piece of evidence: its content, else its quote; NULL unless it is PRESENT and has one."""
    return F.when(availability == "PRESENT", F.coalesce(F.nullif(content, F.lit("")), F.nullif(span["quote"], F.lit(""))))
