"""Tables kept by the keys that they are joined on, so that links join without a shuffle.

The assertions' own references and evidence are kept in equally many buckets of evidence_id, assertions in
buckets of assertion_id. What candidates add is kept once a pool (see operators/links.py), not once an
assertion, which would grow with the square of the tables: the links of each pool, with the evidence they
name, and the pool's assertions, both in buckets of the pool. Links are then told bucket by bucket.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from attestra.operators.links import by_pool, members, named, own_references, pooled
from attestra.plans.store import checkpointed
from attestra.tables import KeptPools, ProvenanceTables


def bucketed(t: ProvenanceTables, name: str, buckets: int = 64) -> ProvenanceTables:
    """Save the tables as ``name``_assertions, ``name``_evidence, ``name``_refs and, if candidates add references, ``name``_pool_links and ``name``_pool_members in the session's warehouse, replacing tables of these names, and give the tables that read them."""
    spark = t.assertions.sparkSession

    def kept(df: DataFrame, table: str, key: str) -> DataFrame:
        df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(f"{name}_{table}")
        return spark.table(f"{name}_{table}")

    evidence = kept(t.evidence, "evidence", "evidence_id")
    assertions = kept(t.assertions, "assertions", "assertion_id")
    held, pools = replace(t, evidence=evidence, assertions=assertions), None
    refs = kept(own_references(held), "refs", "evidence_id")
    if by_pool(held):
        pool_refs = checkpointed(pooled(held))
        links = kept(named(held, pool_refs), "pool_links", "pool")
        pools = KeptPools(links, kept(members(held, None, pool_refs), "pool_members", "pool"), evidence)
    else:
        for table in ("pool_links", "pool_members"):
            spark.sql(f"DROP TABLE IF EXISTS {name}_{table}")
    return replace(held, refs=refs, pools=pools, lookups=t.lookups | {"assertions", "evidence"})


def reopened(t: ProvenanceTables, name: str) -> ProvenanceTables:
    """``t`` with the tables that ``bucketed`` has saved under ``name``."""
    spark = t.assertions.sparkSession
    evidence, pools = spark.table(f"{name}_evidence"), None
    if spark.catalog.tableExists(f"{name}_pool_links"):
        pools = KeptPools(spark.table(f"{name}_pool_links"), spark.table(f"{name}_pool_members"), evidence)
    return replace(t, assertions=spark.table(f"{name}_assertions"), evidence=evidence, refs=spark.table(f"{name}_refs"), pools=pools, lookups=t.lookups | {"assertions", "evidence"})
