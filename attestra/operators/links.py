"""Evidence links of assertions, and the gaps that show in them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestra.functions.spans import evidence_span, evidence_text
from attestra.schemas import BLOCKING, GROUNDING
from attestra.tables import ProvenanceTables


def selected(t: ProvenanceTables, ids: DataFrame | None) -> DataFrame:
    """All assertions, or those named in ids (assertion_id)."""
    return t.assertions if ids is None else t.assertions.join(ids.select("assertion_id").distinct(), "assertion_id", "left_semi")


def references(t: ProvenanceTables, ids: DataFrame | None = None) -> DataFrame:
    """assertion_id, ord, evidence_id, relationship, via_candidate: own references in order (repeats stay), then those of source candidates that add a new pair of evidence and relationship."""
    own = own_references(t, ids)
    return own if not by_pool(t) else own.unionByName(added(t, ids, pooled(t, ids)).select(*own.columns))


def _kept_references(t: ProvenanceTables, ids: DataFrame | None) -> DataFrame:
    kept = t.refs.select("assertion_id", "ord", "evidence_id", "relationship", "via_candidate")
    return kept if ids is None else kept.join(ids.select("assertion_id").distinct(), "assertion_id", "left_semi")


def own_references(t: ProvenanceTables, ids: DataFrame | None = None) -> DataFrame:
    """The references of the assertions themselves (all, if these are kept together), with the columns of ``references``."""
    if t.refs is not None:
        return _kept_references(t, ids)
    rows = selected(t, ids).select("assertion_id", F.posexplode("evidence_refs").alias("ord", "ref"))
    return rows.select("assertion_id", "ord", "ref.evidence_id", "ref.relationship", F.lit(None).cast("string").alias("via_candidate"))


# Assertions of equal lists of source candidates (a pool) get the same references from them, but for those that they
# have themselves. So these are put in order, counted and joined to evidence once a pool, and only then told for each
# assertion, by a join that nothing is shuffled after. What is merely counted is never told at all.


def pools(t: ProvenanceTables, ids: DataFrame | None = None) -> DataFrame:
    """assertion_id, pool, n_own, evidence_refs of the assertions with source candidates."""
    rows = selected(t, ids).select("assertion_id", F.col("source_candidate_ids").alias("pool"), F.coalesce(F.size("evidence_refs"), F.lit(0)).alias("n_own"), "evidence_refs")
    return rows.where(F.size("pool") > 0)


def pooled(t: ProvenanceTables, ids: DataFrame | None = None) -> DataFrame:
    """pool, place, evidence_id, relationship, via_candidate: the pairs of evidence and relationship that the candidates of each pool name, once each, in order from place 1."""
    if t.pools is not None:
        kept = t.pools.links if ids is None else t.pools.links.join(pools(t, ids).select("pool").distinct(), "pool", "left_semi")
        return kept.select("pool", "place", "evidence_id", "relationship", "via_candidate")
    refs = t.candidate_refs.withColumnRenamed("ord", "ref_ord")
    if t.errors is not None:  # a candidate whose references can't all be read has none
        refs = refs.join(_unreadable(t, "candidate_refs").select("subject_id"), "subject_id", "left_anti")
    named = pools(t, ids).select("pool").distinct().select("pool", F.posexplode("pool").alias("cand_ord", "subject_id"))
    once = named.join(refs, "subject_id").groupBy("pool", "evidence_id", "relationship").agg(F.min(F.struct("cand_ord", "ref_ord", "subject_id")).alias("first"))
    place = F.row_number().over(W.partitionBy("pool").orderBy("first.cand_ord", "first.ref_ord", "evidence_id", "relationship"))
    return once.select("pool", place.alias("place"), "evidence_id", "relationship", F.col("first.subject_id").alias("via_candidate"))


def _held(t: ProvenanceTables, ids: DataFrame | None, pool_refs: DataFrame) -> DataFrame:
    """assertion_id, evidence_id, relationship, place: own references, and the place of their pair in the assertion's pool, on the first of equal ones only."""
    own = pools(t, ids).select("assertion_id", "pool", "evidence_refs", F.posexplode("evidence_refs").alias("ord", "ref"))
    own = own.select("assertion_id", "pool", "ref.evidence_id", "ref.relationship", (F.array_position("evidence_refs", F.col("ref")) == F.col("ord") + 1).alias("first"))
    return own.join(pool_refs.select("pool", "evidence_id", "relationship", "place"), ["pool", "evidence_id", "relationship"]).where("first").select("assertion_id", "evidence_id", "relationship", "place")


def by_pool(t: ProvenanceTables) -> bool:
    """Whether candidates add references that aren't kept among the others."""
    return t.pools is not None or (t.refs is None and t.candidate_refs is not None)


def members(t: ProvenanceTables, ids: DataFrame | None, pool_refs: DataFrame) -> DataFrame:
    """assertion_id, pool, n_own, covered (the places of pairs that the assertion has itself; NULL: none) of the assertions with source candidates."""
    if t.pools is not None:
        kept = t.pools.members
        return kept if ids is None else kept.join(ids.select("assertion_id").distinct(), "assertion_id", "left_semi")
    covered = _held(t, ids, pool_refs).groupBy("assertion_id").agg(F.collect_list("place").alias("covered"))
    return pools(t, ids).select("assertion_id", "pool", "n_own").join(covered, "assertion_id", "left")


def added(t: ProvenanceTables, ids: DataFrame | None, pool_rows: DataFrame, pool_refs: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """assertion_id, ord and the columns of ``pool_rows`` but pool and place (rows of ``pooled``, or what was made of them) for each assertion of the pool that hasn't the pair itself; ``pool_refs``: the pairs, where ``pool_rows`` hasn't all of them; ``rows``: rows (with assertion_id) that each of them is told for, in place of each assertion."""
    each = members(t, ids, pool_rows if pool_refs is None else pool_refs)
    each = each if rows is None else each.join(rows, "assertion_id")
    rows = each.join(pool_rows, "pool").where(F.col("covered").isNull() | ~F.array_contains("covered", F.col("place")))
    before = F.when(F.col("covered").isNull(), F.lit(0)).otherwise(F.size(F.filter("covered", lambda p: p < F.col("place"))))
    return rows.withColumn("ord", F.col("n_own") + F.col("place") - 1 - before).drop("pool", "place", "n_own", "covered")


def counted(t: ProvenanceTables, ids: DataFrame | None = None) -> DataFrame:
    """assertion_id, n_links, n_backing (present, of a grounding relationship), n_supporting (of these, those that support) and n_added (from candidates) of every assertion, without the references that candidates add."""
    facts = t.evidence.select("evidence_id", "availability")
    backs = (F.col("availability") == "PRESENT") & F.col("relationship").isin(*GROUNDING)
    told = (backs.alias("backs"), (backs & (F.col("relationship") == "SUPPORTS")).alias("supports"))
    count = lambda *more: (F.count("*").alias("n_links"), F.count_if("backs").alias("n_backing"), F.count_if("supports").alias("n_supporting"), *more)
    rows, zero = selected(t, ids), lambda *cs: [F.coalesce(c, F.lit(0)).alias(c) for c in cs]
    if not by_pool(t):
        total = references(t, ids).join(facts, "evidence_id", "left").select("assertion_id", "via_candidate", *told).groupBy("assertion_id").agg(*count(F.count("via_candidate").alias("n_added")))
        return rows.select("assertion_id").join(total, "assertion_id", "left").select("assertion_id", *zero("n_links", "n_backing", "n_supporting", "n_added"))
    pool_refs = pooled(t, ids)
    own = own_references(t, ids).join(facts, "evidence_id", "left").select("assertion_id", F.lit(1).alias("sign"), *told)
    held = _held(t, ids, pool_refs).join(facts, "evidence_id", "left").select("assertion_id", F.lit(-1).alias("sign"), *told)
    signed = lambda c: F.sum(F.when(F.col(c), F.col("sign")).otherwise(0))
    mine = own.unionByName(held).groupBy("assertion_id").agg(F.sum("sign").alias("n"), signed("backs").alias("b"), signed("supports").alias("s"), F.count_if(F.col("sign") < 0).alias("twice"))
    whole = pool_refs.join(facts, "evidence_id", "left").select("pool", *told).groupBy("pool").agg(*count())
    every = rows.select("assertion_id", F.col("source_candidate_ids").alias("pool")).join(whole, "pool", "left").join(mine, "assertion_id", "left")
    n = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return every.select("assertion_id", n("n_links", "n").alias("n_links"), n("n_backing", "b").alias("n_backing"), n("n_supporting", "s").alias("n_supporting"), n("n_links", -F.col("twice")).alias("n_added"))


def _unreadable(t: ProvenanceTables, *sources: str) -> DataFrame:
    """subject_id, why: one row for each record of these sources that can't be read."""
    return t.errors.where(F.col("source").isin(*sources)).groupBy("subject_id").agg(F.min(F.concat("source", F.lit(": "), "detail")).alias("why"))


#: Gaps that say a lookup found nothing, and where it looked.
LOST = {"DANGLING_EVIDENCE_REF": ("evidence",), "UNRESOLVED_LINEAGE_INPUT": ("evidence", "assertions"), "UNRESOLVED_SUCCESSOR": ("assertions",), "UNKNOWN_ASSERTION": ("assertions",)}


def store_errors(t: ProvenanceTables, gaps: DataFrame) -> DataFrame:
    """STORE_ERROR rows (the columns of ``gaps``) for the lookups that found nothing because the record can't be read. Only gaps of these kinds meet the errors."""
    rows = None
    for sources in dict.fromkeys(LOST.values()):
        kinds = [k for k, s in LOST.items() if s == sources]
        found = gaps.where(F.col("kind").isin(*kinds)).join(_unreadable(t, *sources), "subject_id")
        rows = found if rows is None else rows.unionByName(found)
    told = {"kind": F.lit("STORE_ERROR"), "detail": F.concat(F.lit("it can't be read: "), "why"), "blocking": F.lit(False)}
    return rows.withColumns({c: v for c, v in told.items() if c in gaps.columns}).select(*gaps.columns)


def named(t: ProvenanceTables, refs: DataFrame) -> DataFrame:
    """``refs`` (with evidence_id and relationship) and the evidence that they name, as ``links`` tells it."""
    e = t.evidence.select(
        "evidence_id", "source_type", "source_locator", "observed_at", "availability", "absence_reason", "error", "payload_hash", "content", F.col("span").alias("own_span"), "provenance", "redacted_at", "redaction_reason",
        F.lit(True).alias("held"), evidence_span(F.col("source_locator"), F.col("span")).alias("span"),
    )
    return (
        refs.join(e, "evidence_id", "left")
        .withColumn("resolved", F.coalesce("held", F.lit(False)))
        .withColumn("model_version", F.col("provenance.model_version"))
        .withColumn("backs", F.coalesce(F.col("resolved") & (F.col("availability") == "PRESENT") & F.col("relationship").isin(*GROUNDING), F.lit(False)))
        .drop("held")
    )


def links(t: ProvenanceTables, ids: DataFrame | None = None) -> DataFrame:
    """Every reference with the evidence it names (NULL columns if the registry has none), its span and whether it grounds."""
    own = named(t, own_references(t, ids))
    if not by_pool(t):
        return own
    if t.pools is not None and t.pools.evidence is t.evidence:
        return own.unionByName(added(t, ids, t.pools.links))
    pool_refs = pooled(t, ids)
    return own.unionByName(added(t, ids, named(t, pool_refs), pool_refs))


def texts_for(t: ProvenanceTables, rows: DataFrame, relationships: tuple[str, ...], ids: DataFrame | None = None, read: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``rows`` (with assertion_id, one of those in ids) times ord, evidence_id and evidence_text of the readable evidence that their assertion cites in one of the relationships. Texts meet rows last, those that candidates add by pool, so that they aren't shuffled once a row; ``read``: columns made of evidence_text, likewise once a piece of evidence."""
    texts = t.evidence.select("evidence_id", evidence_text(F.col("availability"), F.col("content"), F.col("span")).alias("evidence_text")).where("evidence_text is not null")
    made = (lambda df, key: df) if read is None else (lambda df, key: read(df.repartition(key)))  # made after the shuffle, which then holds the text alone
    wanted = F.col("relationship").isin(*relationships)

    def told(refs: DataFrame) -> DataFrame:
        return refs.where(wanted).select("assertion_id", "ord", "evidence_id").join(rows, "assertion_id").join(made(texts, "evidence_id"), "evidence_id")

    if not by_pool(t):
        return told(references(t, ids))
    own, pool_refs = told(own_references(t, ids)), pooled(t, ids)
    theirs = made(pool_refs.where(wanted).select("pool", "place", "evidence_id").join(texts, "evidence_id"), "pool")
    return own.unionByName(added(t, ids, theirs, pool_refs, rows).select(*own.columns))


def grounding_texts(t: ProvenanceTables, rows: DataFrame, ids: DataFrame | None = None, small: bool = False) -> DataFrame:
    """``rows`` (with assertion_id, one of those in ids) and texts: what the grounding evidence of the assertion says, in order of its links, repeats included. The texts that candidates add are gathered once a pool and joined last, so that they aren't shuffled once an assertion; ``small``: evidence may be broadcast."""
    readable = t.evidence.select("evidence_id", evidence_text(F.col("availability"), F.col("content"), F.col("span")).alias("text")).where("text is not null")
    readable = F.broadcast(readable) if small else readable

    def listed(refs: DataFrame, key: str, place: str) -> DataFrame:
        each = refs.where(F.col("relationship").isin(*GROUNDING)).select(key, F.col(place).alias("place"), "evidence_id")
        each = each.repartition(key) if small else each  # then ids are shuffled, and texts are not
        return each.join(readable, "evidence_id").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("texts"))

    none, columns = F.array().cast("array<string>"), rows.columns
    if not by_pool(t):
        return rows.join(listed(references(t, ids), "assertion_id", "ord"), "assertion_id", "left").select(*columns, F.coalesce("texts.text", none).alias("texts"))
    pool_refs = pooled(t, ids)
    own = listed(own_references(t, ids), "assertion_id", "ord").select("assertion_id", F.col("texts.text").alias("own"))
    covered = _held(t, ids, pool_refs).groupBy("assertion_id").agg(F.collect_list("place").alias("covered"))
    found = rows.join(pools(t, ids).select("assertion_id", "pool"), "assertion_id", "left").join(own, "assertion_id", "left").join(covered, "assertion_id", "left")
    found = found.join(listed(pool_refs, "pool", "place"), "pool", "left")
    fresh = F.filter("texts", lambda x: ~F.array_contains("covered", x["place"]))
    theirs = F.when(F.col("covered").isNull(), F.col("texts.text")).otherwise(F.transform(fresh, lambda x: x["text"]))
    return found.select(*columns, F.concat(F.coalesce("own", none), F.coalesce(theirs, none)).alias("texts"))


def any_linked(t: ProvenanceTables, ids: DataFrame | None, evidence: DataFrame) -> DataFrame:
    """assertion_id of those with a reference to some of ``evidence`` (evidence_id)."""
    wanted = evidence.select("evidence_id")
    if not by_pool(t):
        return references(t, ids).join(wanted, "evidence_id", "left_semi").select("assertion_id").distinct()
    through = pools(t, ids).select("assertion_id", "pool").join(pooled(t, ids).join(wanted, "evidence_id", "left_semi").select("pool").distinct(), "pool", "left_semi")
    return own_references(t, ids).join(wanted, "evidence_id", "left_semi").select("assertion_id").unionByName(through.select("assertion_id")).distinct()


def linked_among(t: ProvenanceTables, named: DataFrame) -> DataFrame:
    """The rows of ``named`` (assertion_id, evidence_id) that are references of their assertion, once each."""
    ids, pair = named.select("assertion_id").distinct(), ["assertion_id", "evidence_id"]
    if not by_pool(t):
        return named.join(references(t, ids), pair, "left_semi").select(*pair).distinct()
    through = named.join(pools(t, ids).select("assertion_id", "pool"), "assertion_id").join(pooled(t, ids).select("pool", "evidence_id"), ["pool", "evidence_id"], "left_semi")
    return named.join(own_references(t, ids), pair, "left_semi").select(*pair).unionByName(through.select(*pair)).distinct()


def _gap(kind: str, subject: Column, detail: Column | str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), subject.alias("subject_id"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))


def _shown_gaps(t: ProvenanceTables, refs: DataFrame, *keys: str) -> DataFrame:
    """The keys of ``refs``, subject_id, sub, kind, before and after: the gaps of each reference. The detail is what comes before the assertion's id and after it, or ``before`` alone."""
    # What the gaps need of a piece of evidence is decided on its own row, so that no content goes through the join.
    span = evidence_span(F.col("source_locator"), F.col("span"))
    facts = t.evidence.select("evidence_id", "availability", "absence_reason", "error", "redacted_at", "redaction_reason", F.col("content").isNull().alias("bare"), span["typed"].alias("typed"), F.lit(True).alias("held"))
    resolved = F.coalesce("held", F.lit(False))
    present = resolved & (F.col("availability") == "PRESENT")
    redacted = present & F.col("redacted_at").isNotNull()
    # A detail that names the assertion is kept as what comes before and after its id; others have no end.
    told = lambda kind, before, after=None: F.struct(F.lit(kind).alias("kind"), before.alias("before"), F.lit(None).cast("string").alias("after") if after is None else after.alias("after"))
    each = F.array(
        F.when(~resolved, told("DANGLING_EVIDENCE_REF", F.lit(""), F.concat(F.lit(" cites evidence that is not in the registry"), F.coalesce(F.concat(F.lit(" (candidate "), "via_candidate", F.lit(")")), F.lit(""))))),
        F.when(resolved & (F.col("availability") == "ABSENT"), told("EVIDENCE_ABSENT", F.concat(F.lit("absent: "), F.coalesce("absence_reason", F.lit("unknown"))))),
        F.when(resolved & (F.col("availability") == "ERROR"), told("EVIDENCE_ERROR", F.concat(F.lit("error: "), F.coalesce("error", F.lit("unknown"))))),
        F.when(redacted, told("REDACTED_EVIDENCE", F.concat(F.lit("redacted at "), "redacted_at", F.coalesce(F.concat(F.lit(": "), F.nullif("redaction_reason", F.lit(""))), F.lit(""))))),
        F.when(present & F.col("redacted_at").isNull() & F.col("bare"), told("HASH_ONLY_EVIDENCE", F.lit("only the payload's hash is kept"))),
        F.when(present & F.col("typed").isNull(), told("NO_SPAN", F.lit("no characters are named"))),
        F.when(present & ~F.col("typed"), told("UNTYPED_SPAN", F.lit("the characters come from the locator"))),
        F.when(resolved & (F.col("relationship") == "CONTRADICTS"), told("CONTRADICTING_EVIDENCE", F.lit("it contradicts "), F.lit(""))),
    )

    rows = refs.join(facts, "evidence_id", "left").select(*keys, F.col("evidence_id").alias("subject_id"), F.posexplode(each).alias("sub", "gap"))
    return rows.where("gap is not null").select(*keys, "subject_id", "sub", "gap.*")


def reference_gaps(t: ProvenanceTables, refs: DataFrame, *keys: str) -> DataFrame:
    """The gaps of references (see ``_shown_gaps``), with STORE_ERROR rows before those of evidence that can't be read."""
    found = _shown_gaps(t, refs, *keys)
    if t.errors is None:
        return found
    lost = found.where(F.col("kind").isin(*(k for k, sources in LOST.items() if "evidence" in sources))).join(_unreadable(t, "evidence"), "subject_id")
    told = {"kind": F.lit("STORE_ERROR"), "before": F.concat(F.lit("it can't be read: "), "why"), "after": F.lit(None).cast("string"), "sub": F.lit(-1)}
    return found.unionByName(lost.withColumns(told).select(*found.columns))


def link_gaps(t: ProvenanceTables, ids: DataFrame | None = None, through: bool = True) -> DataFrame:
    """assertion_id, phase, ord, sub, kind, subject_id, detail, blocking: all gaps but those of walks and of the audit, in the order (phase, ord, sub); not ``through``: without those of references that candidates add."""
    own = F.col("assertion_id")
    keys = ("assertion_id", "ord")
    found = _shown_gaps(t, own_references(t, ids) if by_pool(t) else references(t, ids), *keys)
    if by_pool(t) and through:
        pool_refs = pooled(t, ids)
        found = found.unionByName(added(t, ids, _shown_gaps(t, pool_refs, "pool", "place"), pool_refs).select(*found.columns))
    detail = F.coalesce(F.concat("before", own, "after"), "before").alias("detail")
    per_link = found.select("assertion_id", F.lit(2).alias("phase"), "ord", "sub", F.struct("kind", "subject_id", detail).alias("gap"))
    total = counted(t, ids)
    a = selected(t, ids).select("assertion_id", "status", F.coalesce(F.size("evidence_refs"), F.lit(0)).alias("n_own"), F.coalesce(F.size("source_candidate_ids"), F.lit(0)).alias("n_candidates"), F.col("derivation").isNotNull().alias("derived"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    whole = F.array(
        F.when(F.coalesce(F.col("status"), F.lit("")) != "ACTIVE", F.struct(F.lit(0).alias("phase"), F.lit(0).alias("ord"), _gap("NOT_ACTIVE", own, F.concat(F.lit("status "), F.coalesce("status", F.lit("none")))).alias("gap"))),
        F.when((F.col("n_candidates") == 0) & ~F.col("derived"), F.struct(F.lit(1).alias("phase"), F.lit(0).alias("ord"), _gap("NO_SOURCE_CANDIDATE", own, "neither candidate nor derivation").alias("gap"))),
        F.when((n("n_added") > 0) & (F.col("n_own") == 0), F.struct(F.lit(1).alias("phase"), F.lit(1).alias("ord"), _gap("EVIDENCE_VIA_CANDIDATE", own, F.concat(n("n_added").cast("string"), F.lit(" reference(s) come from source candidates only"))).alias("gap"))),
        F.when(n("n_links") == 0, F.struct(F.lit(1).alias("phase"), F.lit(2).alias("ord"), _gap("NO_EVIDENCE_REFS", own, F.concat(F.lit("no evidence is cited"), F.when(F.col("derived"), F.lit(" (derived; see lineage)")).otherwise(F.lit("")))).alias("gap"))),
        F.when((n("n_links") > 0) & (n("n_backing") == 0), F.struct(F.lit(3).alias("phase"), F.lit(0).alias("ord"), _gap("NO_PRESENT_EVIDENCE", own, "nothing present supports it or yields it").alias("gap"))),
        F.when((n("n_backing") > 0) & (n("n_supporting") == 0), F.struct(F.lit(3).alias("phase"), F.lit(1).alias("ord"), _gap("NO_SUPPORTS_RELATIONSHIP", own, "present evidence yields it, but none is known to support it").alias("gap"))),
    )
    per_assertion = a.join(total, "assertion_id", "left").select("assertion_id", F.explode(F.array_compact(whole)).alias("g")).select("assertion_id", "g.phase", "g.ord", F.lit(0).alias("sub"), "g.gap")
    out = per_link.unionByName(per_assertion).select("assertion_id", "phase", "ord", "sub", "gap.*")
    if ids is not None:
        missing = ids.select("assertion_id").distinct().join(t.assertions, "assertion_id", "left_anti")
        unknown = missing.select("assertion_id", F.lit(0).alias("phase"), F.lit(0).alias("ord"), F.lit(0).alias("sub"), _gap("UNKNOWN_ASSERTION", own, "no assertion has this id").alias("gap")).select("assertion_id", "phase", "ord", "sub", "gap.*")
        out = out.unionByName(unknown)
    out = out.withColumn("blocking", F.col("kind").isin(*BLOCKING))
    if t.errors is None:
        return out
    named = selected(t, ids).select("assertion_id", F.posexplode("source_candidate_ids").alias("ord", "subject_id")).groupBy("assertion_id", "subject_id").agg(F.min("ord").alias("ord"))
    silent = named.join(_unreadable(t, "candidate_refs"), "subject_id").select("assertion_id", F.lit(1).alias("phase"), F.lit(0).alias("ord"), (F.col("ord") + 1).alias("sub"), F.lit("STORE_ERROR").alias("kind"), "subject_id", F.concat(F.lit("it can't be read: "), "why").alias("detail"), F.lit(False).alias("blocking"))
    return out.unionByName(store_errors(t, out).withColumn("sub", F.lit(-1))).unionByName(silent)


def grounded(t: ProvenanceTables, ids: DataFrame | None = None) -> DataFrame:
    """assertion_id, n_links, n_present and grounded: whether present evidence supports or yields it. Equal to having no blocking gap, without building the gaps."""
    return counted(t, ids).select("assertion_id", "n_links", F.col("n_backing").alias("n_present"), (F.col("n_backing") > 0).alias("grounded"))
