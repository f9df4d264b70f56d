"""The driver tables read as provenance tables: the same portable SQL gives Spark its flat rows and the oracle its views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.plans.store import checkpointed
from attestra.tables import ProvenanceTables

#: Each view's SQL runs in Spark and in DuckDB; a view may use the ones before it.
VIEWS = {
    "evidence_rows": """
        SELECT concat('ev_', d.doc_id) AS evidence_id, d.doc_id,
               CASE WHEN d.doc_id % 4 IN (0, 1) THEN concat(d.source, '#chunk:', d.doc_id % 7, '@chars:0-', d.n_chars)
                    WHEN d.doc_id % 4 = 2 THEN concat(d.source, '#chars:10-', d.n_chars)
                    ELSE concat(d.source, '@doc=', d.doc_id) END AS source_locator,
               CASE WHEN l.toxic = 1 THEN 'ERROR' WHEN l.quality = 0 THEN 'ABSENT' ELSE 'PRESENT' END AS availability,
               CASE WHEN d.doc_id % 5 = 4 THEN NULL ELSE d.text END AS content,
               CASE WHEN d.doc_id % 4 = 0 THEN 0 END AS span_start,
               CASE WHEN d.doc_id % 4 = 0 THEN CAST(least(d.n_chars, 120) AS INT) END AS span_end,
               CASE WHEN d.doc_id % 4 = 0 THEN substring(d.text, 1, 120) END AS span_quote,
               CASE WHEN d.doc_id % 13 = 0 THEN '2024-02-03T04:05:06Z' END AS redacted_at
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "totals": "SELECT count(*) AS nd FROM documents",
    "order_rows": """
        SELECT o_orderkey AS k, concat('as_o', o_orderkey) AS assertion_id, concat('customer/', o_custkey) AS subject_identity, o_custkey, o_orderdate,
               CASE WHEN o_orderkey % 211 = 0 THEN concat('as_o', o_orderkey) WHEN o_orderkey % 101 = 0 THEN concat('as_missing_', o_orderkey)
                    WHEN o_orderkey % 3 = 0 THEN concat('as_o', lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) END AS successor,
               lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS follower
        FROM orders""",
    "assertion_rows": """
        SELECT assertion_id, subject_identity, 'order_total' AS predicate, CAST(k % 1000 AS STRING) AS object_value_json, k, superseded_by,
               CASE WHEN superseded_by IS NOT NULL THEN 'SUPERSEDED' WHEN k % 17 = 0 THEN 'REVOKED' ELSE 'ACTIVE' END AS status
        FROM (SELECT *, CASE WHEN k % 3 = 0 AND k % 211 <> 0 AND k % 101 <> 0 AND follower IS NULL THEN NULL ELSE successor END AS superseded_by FROM order_rows) o
        UNION ALL SELECT concat('as_c', c_custkey), concat('customer/', c_custkey), 'order_sum', '0', NULL, NULL, 'ACTIVE' FROM customer
        UNION ALL SELECT concat('as_n', n_nationkey), concat('nation/', n_nationkey), 'order_sum', '0', NULL, NULL, 'ACTIVE' FROM nation
        UNION ALL SELECT concat('as_r', r_regionkey), concat('region/', r_regionkey), 'order_sum', '0', NULL, NULL, 'ACTIVE' FROM region""",
    "own_refs": """
        SELECT assertion_id, 0 AS ord, concat('ev_', k % (nd + 20)) AS evidence_id,
               CASE k % 5 WHEN 0 THEN 'SUPPORTS' WHEN 3 THEN 'CONTRADICTS' WHEN 4 THEN 'CONTEXTUALIZES' ELSE 'DERIVED_FROM' END AS relationship
        FROM assertion_rows CROSS JOIN totals WHERE k % 4 <> 3
        UNION ALL SELECT assertion_id, 1, concat('ev_', (k * 7) % nd), 'DERIVED_FROM' FROM assertion_rows CROSS JOIN totals WHERE k % 4 = 2""",
    "own_candidates": "SELECT assertion_id, 0 AS ord, concat('cand_', k % 500) AS candidate_id FROM assertion_rows WHERE k % 6 <> 5",
    "candidate_rows": """
        SELECT concat('cand_', p_partkey % 700) AS subject_id, CAST(row_number() OVER (PARTITION BY p_partkey % 700 ORDER BY p_partkey) - 1 AS INT) AS ord,
               concat('ev_', p_partkey % (nd + 20)) AS evidence_id, CASE WHEN p_partkey % 2 = 0 THEN 'SUPPORTS' ELSE 'DERIVED_FROM' END AS relationship
        FROM part CROSS JOIN totals""",
    "input_rows": """
        SELECT concat('as_c', o_custkey) AS assertion_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS ord, 'assertion' AS kind, concat('as_o', o_orderkey) AS ref FROM orders
        UNION ALL SELECT concat('as_c', c_custkey), 1000000, 'evidence', concat('ev_', c_custkey % (nd + 20)) FROM customer CROSS JOIN totals
        UNION ALL SELECT concat('as_n', c_nationkey), CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INT), 'assertion', concat('as_c', c_custkey) FROM customer
        UNION ALL SELECT concat('as_n', n_nationkey), 1000000, 'assertion', concat('as_c', lowest) FROM nation
             JOIN (SELECT n_regionkey AS region, min(c_custkey) AS lowest FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey) x ON n_regionkey = region
        UNION ALL SELECT concat('as_r', n_regionkey), CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT), 'assertion', concat('as_n', n_nationkey) FROM nation
        UNION ALL SELECT concat('as_r', r_regionkey), 1000000, 'assertion', concat('as_nope_', r_regionkey) FROM region
        UNION ALL SELECT concat('as_r', r_regionkey), 1000001, 'artifact', concat('art_', r_regionkey) FROM region""",
}


def views(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """The named views (and what they rest on) as DataFrames."""
    found: dict[str, DataFrame] = {}
    for table in ("documents", "labels", "orders", "customer", "nation", "region", "part", "conversations", "benchmark", "embeddings", "events"):
        found[table] = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    for name, sql in VIEWS.items():
        used = {t: df for t, df in found.items() if t in sql}
        text = sql
        for t in sorted(used, key=len, reverse=True):
            text = re.sub(rf"(?<![\w.])(FROM|JOIN)(\s+){t}\b(?!\s*\()", rf"\1\2{{{t}}}", text)
        found[name] = spark.sql(text, **{t: df for t, df in used.items() if f"{{{t}}}" in text})
    return {n: found[n] for n in (names or found)}


def provenance(spark: SparkSession, sf_dir: str, max_depth: int = 16, keep: bool = True) -> ProvenanceTables:
    """The driver tables as provenance tables: documents are evidence, orders and their sums are assertions. ``keep``: compute the assertions once, for queries that read them many times."""
    v = views(spark, sf_dir)
    ordered = lambda df, *fields: df.groupBy("assertion_id").agg(F.array_sort(F.collect_list(F.struct("ord", *fields))).alias("list"))
    rows = v["assertion_rows"]
    k, nd = F.col("k"), F.col("nd")
    ref = lambda e, r: F.struct(F.concat(F.lit("ev_"), e.cast("string")).alias("evidence_id"), r.alias("relationship"))
    relationship = F.get(F.array(*map(F.lit, ("SUPPORTS", "DERIVED_FROM", "DERIVED_FROM", "CONTRADICTS", "CONTEXTUALIZES"))), (k % 5).cast("int"))
    first, second = F.when(k % 4 != 3, ref(k % (nd + 20), relationship)), F.when(k % 4 == 2, ref((k * 7) % nd, F.lit("DERIVED_FROM")))
    inputs = ordered(v["input_rows"], "kind", "ref").select(
        "assertion_id", F.struct(F.lit("sum").alias("method"), F.lit("1").alias("implementation_version"), F.lit(True).alias("deterministic"), F.transform("list", lambda x: F.struct(x["kind"].alias("kind"), x["ref"].alias("ref"))).alias("inputs")).alias("derivation")
    )
    null = lambda kind: F.lit(None).cast(kind)
    assertions = (
        rows.crossJoin(F.broadcast(v["totals"]))  # one row
        .join(inputs, "assertion_id", "left")
        .select(
            "assertion_id", "subject_identity", "predicate", "object_value_json", F.lit("int").alias("object_value_type"), null("string").alias("object_identity"), "status",
            F.array_compact(F.array(first, second)).alias("evidence_refs"), "derivation",
            F.when(k % 6 != 5, F.array(F.concat(F.lit("cand_"), (k % 500).cast("string")))).otherwise(F.array().cast("array<string>")).alias("source_candidate_ids"),
            "superseded_by", null("timestamp").alias("superseded_at"), F.lit("2024-01-01T00:00:00Z").cast("timestamp").alias("recorded_at"), F.lit("curation").alias("authority"), F.lit(1).alias("curation_epoch"),
            null("string").alias("trace_id"), F.coalesce(k, F.lit(-1)).alias("load_ord"),
        )
    )
    assertions = checkpointed(assertions) if keep else assertions
    e = v["evidence_rows"]
    evidence = e.select(
        "evidence_id", F.lit("document").alias("source_type"), "source_locator", F.lit("2024-01-01T00:00:00Z").cast("timestamp").alias("observed_at"), "availability",
        F.when(F.col("availability") == "ABSENT", F.lit("withdrawn")).alias("absence_reason"), F.when(F.col("availability") == "ERROR", F.lit("unreadable")).alias("error"), F.concat(F.lit("h"), F.col("doc_id").cast("string")).alias("payload_hash"),
        "content", F.when(F.col("span_start").isNotNull(), F.struct(F.col("span_start").alias("start"), F.col("span_end").alias("end"), F.col("span_quote").alias("quote"))).alias("span"),
        F.struct(F.lit("corpus").alias("source"), null("string").alias("source_ref"), F.lit("extractor").alias("actor"), F.when(F.col("doc_id") % 2 == 0, F.lit("reader")).alias("model"), F.lit("1").alias("model_version"), null("string").alias("prompt_version")).alias("provenance"),
        "redacted_at", null("string").alias("redaction_reason"),
    )
    return ProvenanceTables(assertions, evidence, v["candidate_rows"], max_depth=max_depth)


def oracle(sql: str) -> str:
    """``sql`` with the views as common table expressions, for DuckDB. A text that starts with + goes on with the list of expressions."""
    more = sql.lstrip().startswith("+")
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({text})" for n, text in VIEWS.items()) + (",\n" if more else "\n") + sql.lstrip().removeprefix("+")
