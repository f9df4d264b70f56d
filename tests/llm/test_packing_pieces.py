from __future__ import annotations

import collections

from pyspark.sql import functions as F

from attestra.llm import packing


def test_long_documents_take_whole_sequences_and_ids_stay_with_their_pieces(spark):
    """300 documents of many pieces each: only the remainders are packed together, whatever the columns are called; ids are as they were."""
    rows = [(i % 7 if i % 3 else None, p, 100 if p else 1 + i % 99, f"{i}/{p}") for i in range(300) for p in range(30)]
    found = spark.createDataFrame(rows, "doc_id long, piece int, length long, ids string").withColumns({"row": F.col("ids"), "at": F.lit(1), "k": F.lit(2)}).repartition(5)
    packed = packing.pack(found, 100)
    assert packed.columns == [*found.columns, "sequence_id", "offset"]
    held = collections.defaultdict(list)
    for x in packed.collect():
        assert x["row"] == x["ids"]
        held[x["sequence_id"]].append((x["offset"], x["length"], x["ids"]))
    assert sorted(i for v in held.values() for _, _, i in v) == sorted(r[3] for r in rows)
    for v in held.values():
        v.sort()
        assert [o for o, _, _ in v] == [sum(n for _, n, _ in v[:i]) for i in range(len(v))] and sum(n for _, n, _ in v) <= 100
    rest = sum(r[2] for r in rows if r[2] < 100)
    whole = sum(r[2] >= 100 for r in rows)
    assert len(held) <= whole + 1.03 * rest / 100 + 1


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 200_000), (2, None)], "doc_id long, text string")
    packed = packing.pack(packing.pieces(docs)).collect()
    assert sum(x["length"] for x in packed) == 200_000 + 2 + 1 and all(len(x["ids"]) == 4 * x["length"] for x in packed)
