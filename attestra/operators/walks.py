"""Walks over assertions: supersession, lineage and impact, for all starting points at once.

Each walk goes level by level: one join a level for every start together, the level's rows kept in
the shared checkpoint folder so that the plan stays short. Only whether a level has rows reaches the
driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestra.operators.links import pools, selected, store_errors
from attestra.plans.store import checkpointed
from attestra.tables import ProvenanceTables


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _doubled(pointers: DataFrame, most: int) -> tuple[DataFrame, int]:
    """x, path (the ids that pointers (x, to) lead to from x, ``most`` of them at most) and known (whether the last of them has a row in pointers; to may be null), and the number of joins: each doubles all paths at once."""
    rows = checkpointed(pointers.where("to is not null").select("x", F.array("to").alias("path")))
    rounds, reach = 0, 1
    while reach < most:
        ends = rows.select(F.col("x").alias("end"), F.col("path").alias("more"))
        longer = rows.withColumn("end", F.element_at("path", -1)).join(ends, "end", "left").select("x", F.slice(F.concat("path", F.coalesce("more", F.array().cast("array<string>"))), 1, most).alias("path"), F.col("more").isNotNull().alias("grew"))
        longer = checkpointed(longer)
        rounds, reach = rounds + 1, 2 * reach
        grew = not longer.where("grew").isEmpty()
        rows = longer.drop("grew")
        if not grew:
            break
    known = pointers.select(F.col("x").alias("end"), F.lit(True).alias("known"))
    return rows.withColumn("end", F.element_at("path", -1)).join(known, "end", "left").select("x", "path", F.coalesce("known", F.lit(False)).alias("known")), rounds


def successors(t: ProvenanceTables, ids: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """assertion_id, successors (the ids after it, oldest first), and at most one gap: gap_kind, gap_subject, gap_at.

    A pointer back into the chain ends it (LINEAGE_CYCLE), as does one past ``max_depth``
    (LINEAGE_DEPTH_LIMIT). An unknown id ends it too (UNRESOLVED_SUCCESSOR), but stays in the chain.
    Paths double with each join, so a chain of n takes log2(n) of them; each path is judged on its own row.
    """
    depth = t.max_depth if max_depth is None else max_depth
    pointers = t.assertions.select(F.col("assertion_id").alias("x"), F.col("superseded_by").alias("to"))
    paths, _ = _doubled(pointers, depth + 1)
    rows = selected(t, ids).select("assertion_id").join(paths.withColumnRenamed("x", "assertion_id"), "assertion_id", "left")
    line = F.concat(F.array("assertion_id"), "path")  # place 1 is the assertion itself
    place = F.sequence(F.lit(1), F.size("path"))
    again = F.filter(place, lambda i: F.array_position(F.slice(line, F.lit(1), i), F.element_at("path", i)) > 0)
    size, none = F.size("path"), F.lit(None).cast("string")
    cycle = F.try_element_at(again, F.lit(1))
    kind = F.when(cycle.isNotNull(), "LINEAGE_CYCLE").when(size > depth, "LINEAGE_DEPTH_LIMIT").when(~F.col("known"), "UNRESOLVED_SUCCESSOR")
    rows = rows.withColumn("path", F.coalesce("path", F.array().cast("array<string>"))).withColumn("cycle", F.when(F.size("path") > 0, cycle)).withColumn("gap_kind", F.when(size > 0, kind))
    cut = F.when(F.col("gap_kind") == "LINEAGE_CYCLE", F.col("cycle") - 1).when(F.col("gap_kind") == "LINEAGE_DEPTH_LIMIT", F.lit(depth)).otherwise(size)
    at = F.when(F.col("gap_kind") == "UNRESOLVED_SUCCESSOR", size - 1).otherwise(cut)  # so many steps lead to where it shows
    subject = F.when(F.col("gap_kind").isNotNull(), F.element_at("path", F.greatest((at + 1).cast("int"), F.lit(1))))
    where = F.when(F.col("gap_kind").isNotNull(), F.element_at(line, (at + 1).cast("int")))
    return rows.select("assertion_id", F.slice("path", F.lit(1), cut.cast("int")).alias("successors"), F.coalesce("gap_kind", none).alias("gap_kind"), subject.alias("gap_subject"), where.alias("gap_at"))


def current_ids(walked: DataFrame) -> DataFrame:
    """assertion_id and the last of its successors, or itself; the last one may be unknown."""
    return walked.select("assertion_id", F.coalesce(F.try_element_at("successors", F.lit(-1)), "assertion_id").alias("current_assertion_id"))


def lineage(t: ProvenanceTables, ids: DataFrame | None = None, max_depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What each root was derived from: nodes and gaps.

    nodes: root_id, seq (arrival order: level, place of the parent, candidates before inputs, ordinal), kind, ref, depth, parent_ref, method, implementation_version, resolved, via.
    gaps: root_id, seq, kind, subject_id, at; an input whose record can't be read has a STORE_ERROR too. Within one walk an assertion is a node once; each later arrival, a diamond's too, is a LINEAGE_CYCLE gap and no node.
    """
    depth_limit = t.max_depth if max_depth is None else max_depth
    a = t.assertions.select("assertion_id", "derivation", F.coalesce("source_candidate_ids", F.array().cast("array<string>")).alias("candidates"))
    held = t.evidence.select(F.col("evidence_id").alias("held_id")).distinct()
    text = lambda v=None: F.lit(v).cast("string")
    seq = lambda level, pos, part, ord_: F.struct(F.lit(level).alias("level"), F.col(pos).cast("long").alias("parent"), F.lit(part).alias("part"), F.col(ord_).cast("int").alias("ord") if ord_ else F.lit(0).alias("ord")).alias("seq")
    roots = selected(t, ids).select("assertion_id")
    frontier = roots.select(F.col("assertion_id").alias("root_id"), F.col("assertion_id").alias("ref"), F.lit(0).cast("long").alias("pos"))
    seen = frontier.select("root_id", "ref")
    start = a.join(frontier, a["assertion_id"] == frontier["ref"]).withColumn("zero", F.lit(0))
    nodes = [
        start.select(
            "root_id", seq(0, "pos", 0, None), text("assertion").alias("kind"), "ref", F.lit(0).alias("depth"), text().alias("parent_ref"),
            F.col("derivation.method").alias("method"), F.col("derivation.implementation_version").alias("implementation_version"), F.lit(True).alias("resolved"), text("root").alias("via"),
        )
    ]
    gaps = []
    for level in range(depth_limit + 1):
        here = frontier.join(a, frontier["ref"] == a["assertion_id"]).select("root_id", "ref", "pos", "derivation", "candidates")
        leaf = here.select("root_id", "ref", "pos", F.posexplode("candidates").alias("ord", "cand"))
        nodes.append(
            leaf.select("root_id", seq(level + 1, "pos", 0, "ord"), text("candidate").alias("kind"), F.col("cand").alias("ref"), F.lit(level + 1).alias("depth"), F.col("ref").alias("parent_ref"), text().alias("method"), text().alias("implementation_version"), F.lit(True).alias("resolved"), text("source_candidate").alias("via"))
        )
        if level == depth_limit:
            gaps.append(here.where("derivation is not null").select("root_id", seq(level + 1, "pos", 1, None), text("LINEAGE_DEPTH_LIMIT").alias("kind"), F.col("ref").alias("subject_id"), F.col("ref").alias("at")))
            break
        inputs = here.where("derivation is not null").select("root_id", F.col("ref").alias("parent_ref"), "pos", F.posexplode("derivation.inputs").alias("ord", "input")).select("root_id", "parent_ref", "pos", "ord", "input.kind", "input.ref")
        inputs = checkpointed(inputs)
        others = inputs.where("kind <> 'assertion'").join(held, (F.col("kind") == "evidence") & (F.col("ref") == F.col("held_id")), "left").withColumn("resolved", (F.col("kind") != "evidence") | F.col("held_id").isNotNull())
        nodes.append(others.select("root_id", seq(level + 1, "pos", 1, "ord"), "kind", "ref", F.lit(level + 1).alias("depth"), "parent_ref", text().alias("method"), text().alias("implementation_version"), "resolved", text("derivation").alias("via")))
        gaps.append(others.where("not resolved").select("root_id", seq(level + 1, "pos", 1, "ord"), text("UNRESOLVED_LINEAGE_INPUT").alias("kind"), F.col("ref").alias("subject_id"), F.col("parent_ref").alias("at")))
        arrival = W.partitionBy("root_id", "ref").orderBy("pos", "ord")
        arrivals = inputs.where("kind = 'assertion'").withColumn("nth", F.row_number().over(arrival)).join(seen.withColumn("old", F.lit(True)), ["root_id", "ref"], "left")
        arrivals = checkpointed(arrivals)
        again = arrivals.where("nth > 1 or old")
        gaps.append(again.select("root_id", seq(level + 1, "pos", 1, "ord"), text("LINEAGE_CYCLE").alias("kind"), F.col("ref").alias("subject_id"), F.col("parent_ref").alias("at")))
        fresh = arrivals.where("nth = 1 and old is null").join(a.select(F.col("assertion_id").alias("known"), F.col("derivation").alias("d")), F.col("ref") == F.col("known"), "left")
        # Places grow in the order of arrival and may leave gaps: a root over most of the tables is put in order by many tasks.
        fresh = fresh.select("root_id", "ref", "parent_ref", "pos", "ord", "known", F.col("d.method").alias("method"), F.col("d.implementation_version").alias("implementation_version"))
        fresh = checkpointed(fresh.sort("root_id", "pos", "ord").withColumn("place", F.monotonically_increasing_id()))
        nodes.append(fresh.select("root_id", seq(level + 1, "pos", 1, "ord"), text("assertion").alias("kind"), "ref", F.lit(level + 1).alias("depth"), "parent_ref", "method", "implementation_version", F.col("known").isNotNull().alias("resolved"), text("derivation").alias("via")))
        gaps.append(fresh.where("known is null").select("root_id", seq(level + 1, "pos", 1, "ord"), text("UNRESOLVED_LINEAGE_INPUT").alias("kind"), F.col("ref").alias("subject_id"), F.col("parent_ref").alias("at")))
        seen = seen.unionByName(fresh.select("root_id", "ref"))
        frontier = fresh.where("known is not null").select("root_id", "ref", F.col("place").alias("pos"))
        if frontier.isEmpty():
            break
    empty = frontier.select("root_id", seq(0, "pos", 0, None), text().alias("kind"), text().alias("subject_id"), text().alias("at")).where("false")
    gaps = _union([empty, *gaps])
    return _union(nodes), gaps if t.errors is None else gaps.unionByName(store_errors(t, gaps))


MOST_PARTS = 16


def impact(t: ProvenanceTables, evidence: DataFrame | None = None) -> DataFrame:
    """evidence_id, assertion_id, how: what has to be validated again if a piece of evidence changes.

    direct: cites it in a reference of any relationship or as an input; via_candidate: no reference
    cites it, but one of its source candidates does; transitive: derived from such an assertion over
    any number of steps. Each assertion is listed once a piece of evidence, in that order of how.
    """
    wanted = (lambda df: df) if evidence is None else (lambda df: df.join(evidence.select("evidence_id").distinct(), "evidence_id", "left_semi"))
    inputs = t.assertions.select("assertion_id", F.explode("derivation.inputs").alias("i")).select("assertion_id", "i.kind", "i.ref")
    cites = t.assertions.select("assertion_id", F.explode("evidence_refs").alias("r")).select(F.col("r.evidence_id").alias("evidence_id"), "assertion_id")
    uses = inputs.where("kind = 'evidence'").select(F.col("ref").alias("evidence_id"), "assertion_id")
    direct = checkpointed(wanted(cites.unionByName(uses)).distinct())
    found = [direct.withColumn("how", F.lit("direct"))]
    edges = checkpointed(inputs.where("kind = 'assertion'").select(F.col("ref").alias("assertion_id"), F.col("assertion_id").alias("consumer")).distinct())
    pair = ["evidence_id", "assertion_id"]
    if t.candidate_refs is None:
        after = consumers(direct.select("assertion_id").distinct(), edges)
        later = after.join(direct, "assertion_id").select("evidence_id", F.col("consumer").alias("assertion_id")).distinct().join(direct, pair, "left_anti")
        return _union([*found, later.withColumn("how", F.lit("transitive"))])
    # What candidates cite is kept once a pool (see links.py), and told last, by a join that nothing is shuffled after.
    owners = pools(t).select("assertion_id", "pool").distinct()
    named = owners.select("pool").distinct().select("pool", F.explode("pool").alias("subject_id"))
    cited = checkpointed(named.join(wanted(t.reverse_refs().select("evidence_id", "subject_id")), "subject_id").select("pool", "evidence_id").distinct())
    owners = checkpointed(owners.join(cited.select("pool").distinct(), "pool", "left_semi").select("assertion_id", "pool"))
    found.append(_told(owners, cited, direct).withColumn("how", F.lit("via_candidate")))
    after = checkpointed(consumers(direct.select("assertion_id").unionByName(owners.select("assertion_id")).distinct(), edges))
    used = after.join(owners, "assertion_id").select(F.col("consumer").alias("assertion_id"), "pool").distinct()
    used = checkpointed(used.join(owners, ["assertion_id", "pool"], "left_anti"))
    found.append(_told(used, cited, direct, owners).withColumn("how", F.lit("transitive")))
    later = checkpointed(after.join(direct, "assertion_id").select("evidence_id", F.col("consumer").alias("assertion_id")).distinct().join(direct, pair, "left_anti"))
    pooled = later.join(cited, "evidence_id").join(used.unionByName(owners), ["assertion_id", "pool"], "left_semi").select(*pair)
    found.append(later.join(pooled, pair, "left_anti").withColumn("how", F.lit("transitive")))
    return _union(found)


def _told(owners: DataFrame, cited: DataFrame, known: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """evidence_id, assertion_id, once each: what the pools (``cited``: pool, evidence_id) of each assertion cite (``owners``: assertion_id, pool), but for the pairs in ``known`` and those that a pool in ``others`` cites.

    Evidence that two pools of an assertion share is left to the first of them. Only such pairs, and known ones, are shuffled by assertion.
    """
    key = ["assertion_id", "pool"]
    again = cited.withColumnRenamed("pool", "other").join(cited, "evidence_id").where("pool <> other").select("pool", "other", "evidence_id")
    again = checkpointed(again)
    held = owners.select("assertion_id", F.col("pool").alias("other"), F.lit(True).alias("later_only"))
    if others is not None:
        held = held.unionByName(others.select("assertion_id", F.col("pool").alias("other"), F.lit(False).alias("later_only")))
    met = owners.join(again.select("pool", "other").distinct(), "pool").join(held, ["assertion_id", "other"]).where("not later_only or other < pool").select(*key, "other")
    covered = met.join(again, ["pool", "other"]).select(*key, "evidence_id").unionByName(known.join(cited, "evidence_id").join(owners, key, "left_semi").select(*key, "evidence_id"))
    covered = covered.groupBy(*key).agg(F.collect_set("evidence_id").alias("covered"))
    rows = owners.join(covered, key, "left").join(cited, "pool")
    return rows.where(F.col("covered").isNull() | ~F.coalesce(F.array_contains("covered", F.col("evidence_id")), F.lit(False))).select("evidence_id", "assertion_id")


def consumers(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """assertion_id, consumer: what is derived from each source over any number of edges (assertion_id, consumer); a source on a cycle isn't its own.

    The closure is one of assertions: evidence, of which each may have many pieces, is joined to it once at the end. A round joins only what the last one has found.
    """
    delta = checkpointed(sources.join(edges, "assertion_id").where("assertion_id <> consumer").select("assertion_id", "consumer"))
    known, parts, rounds = delta, edges.select(F.col("assertion_id").alias("consumer"), F.col("consumer").alias("next")), 0
    while not delta.isEmpty():
        reached = delta.join(parts, "consumer").where("assertion_id <> next").select("assertion_id", F.col("next").alias("consumer")).distinct()
        delta = checkpointed(reached.join(known, ["assertion_id", "consumer"], "left_anti"))
        known, rounds = known.unionByName(delta), rounds + 1
        if rounds % MOST_PARTS == 0:
            known = checkpointed(known)  # the parts are kept already; one table of them keeps the plans of long chains short
    return known


def citing_candidates(t: ProvenanceTables) -> DataFrame:
    """evidence_id and the candidates that cite it, once each, in registry order."""
    first = t.reverse_refs().groupBy("evidence_id", "subject_id").agg(F.min("ord").alias("ord"))
    return first.groupBy("evidence_id").agg(F.array_sort(F.collect_list(F.struct("ord", "subject_id"))).alias("c")).select("evidence_id", F.col("c.subject_id").alias("candidates"))


def neighbours(t: ProvenanceTables, max_group: int = 50) -> DataFrame:
    """assertion_id, neighbour: one step over derivation and supersession, both ways, and over shared subject or object identities of at most ``max_group`` assertions.

    Each pair is told once, and pairs are never shuffled: those that share a small identity come from the
    first such identity, and steps add only pairs that share none.
    """
    named = t.assertions.select("assertion_id", F.explode_outer(F.array("subject_identity", "object_identity")).alias("identity"))
    own = checkpointed(named.groupBy("assertion_id").agg(F.collect_set(F.when(F.col("identity") != "", F.col("identity"))).alias("ids")))
    # The size is counted by a plain aggregation first, so a hub's members never meet in one task.
    hubs = checkpointed(own.select(F.explode("ids").alias("identity")).groupBy("identity").agg(F.count("*").alias("n")).where(F.col("n") > max_group).select("identity"))
    if not hubs.isEmpty():
        each = own.select("assertion_id", F.explode_outer("ids").alias("identity")).join(hubs.withColumn("hub", F.lit(True)), "identity", "left")
        own = checkpointed(each.groupBy("assertion_id").agg(F.collect_set(F.when(F.col("hub").isNull(), F.col("identity"))).alias("ids")))
    several = F.when(F.size("ids") > 1, F.col("ids"))
    members = own.select(F.explode("ids").alias("identity"), "assertion_id", several.alias("ids"))
    other = members.select("identity", F.col("assertion_id").alias("neighbour"), F.col("ids").alias("its_ids"))
    met = F.exists("ids", lambda x: (x < F.col("identity")) & F.array_contains("its_ids", x))  # at an identity before
    shared = members.join(other, "identity").where((F.col("assertion_id") != F.col("neighbour")) & ~F.coalesce(met, F.lit(False))).select("assertion_id", "neighbour")
    derived = t.assertions.select("assertion_id", F.explode("derivation.inputs").alias("i")).where("i.kind = 'assertion'").select("assertion_id", F.col("i.ref").alias("neighbour"))
    replaced = t.assertions.where("superseded_by <> ''").select("assertion_id", F.col("superseded_by").alias("neighbour"))
    steps = derived.unionByName(replaced).join(own, "assertion_id").join(own.select(F.col("assertion_id").alias("neighbour"), F.col("ids").alias("its_ids")), "neighbour")
    apart = steps.where((F.col("assertion_id") == F.col("neighbour")) | ~F.arrays_overlap("ids", "its_ids"))
    ends = apart.select(F.least("assertion_id", "neighbour").alias("low"), F.greatest("assertion_id", "neighbour").alias("high")).distinct()
    pair = lambda a, b: F.struct(F.col(a).alias("assertion_id"), F.col(b).alias("neighbour"))
    both = ends.select(F.explode(F.array_distinct(F.array(pair("low", "high"), pair("high", "low")))).alias("e")).select("e.assertion_id", "e.neighbour")
    return both.unionByName(shared)
