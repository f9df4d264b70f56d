"""Cutting lineage in the shared folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local session (as in tests) gets one; on a cluster that is an error, since no other folder is known to be shared."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="attestra-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


KEPT: list[str] = []  # folders that ``written`` has made in this process, for those who can tell when nothing reads them any more


def written(df: DataFrame, form: str = "parquet") -> tuple[DataFrame, str]:
    """``df``, computed once and read again from a table in the shared folder, and the table's path. Unlike after a checkpoint the plan then knows the true size, which matters in long loops."""
    path = f"{shared_folder(df.sparkSession)}/attestra-{uuid.uuid4().hex}"
    KEPT.append(path)
    df.write.format(form).save(path)
    return df.sparkSession.read.schema(df.schema).format(form).load(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate results that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def released(spark: SparkSession, mark: int) -> None:
    """Delete what ``written`` has made since ``KEPT`` was ``mark`` long."""
    for path in KEPT[mark:]:
        removed(spark, path)
    del KEPT[mark:]


def fits(df: DataFrame, text: str, most: int) -> bool:
    """Whether ``df``, whose size is that of its column ``text``, may be broadcast: its rows and bytes are counted, unless the files it rests on are already over four times ``most`` bytes (or of unknown size), so that large tables are not read for it."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    if sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())) > 4 * most:
        return False
    return df.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 64), F.lit(0))).first()[0] <= most
