"""A root over many inputs is put in order by more than one task."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.operators import walks
from tests.world import assertion, evidence, tables


def test_places_of_one_root_are_given_by_several_tasks(spark, monkeypatch):
    n, tasks, keep = 400, [], walks.checkpointed

    def kept(df):
        if "place" in df.columns:
            tasks.append(df.where("root_id = 'hub'").select("place", F.spark_partition_id().alias("p")).groupBy("p").agg(F.max("place")).where("max(place) >= 0").count())
        return keep(df)

    monkeypatch.setattr(walks, "checkpointed", kept)
    leaves = [f"l{(i * 7) % n}" for i in range(n)]
    t = tables(spark, [assertion("hub", inputs=[("assertion", x) for x in leaves], candidates=()), *(assertion(x, inputs=[("evidence", "e")], candidates=()) for x in leaves)], [evidence("e")])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        nodes = walks.lineage(t)[0].where("root_id = 'hub'").orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["ref"] for r in nodes] == ["hub", *leaves, *["e"] * n]
    assert [r["parent_ref"] for r in nodes if r["ref"] == "e"] == leaves
    assert tasks[0] > 1
