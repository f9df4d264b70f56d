"""Reading provenance tables: JSON lines, SQLite files, and the environment's choice of them."""

from __future__ import annotations

import importlib
import os
import sqlite3
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from attestra.plans.store import checkpointed
from attestra.schemas import ASSERTIONS, AUDIT_RECORDS, AUDIT_REFS, CANDIDATE_REFS, ERRORS, EVIDENCE, MAX_DEPTH, RELATIONSHIPS
from attestra.tables import ProvenanceTables, deduplicated


# The names of an audit's tables.
AUDIT_NAMES = (("records", "assertion_refs"), ("semantic_audit_records", "semantic_audit_assertions"))
MAX_ASKED = 1000  # values of one condition; SQLite takes 32,766 in a statement
#: The tables that a source can be asked for by id.
TABLES = ("assertions", "evidence", "candidate_refs", "audit_records", "audit_refs")


class ConfigError(ValueError):
    """The configuration or an input file can't be used."""


def _numbered(lines: DataFrame) -> DataFrame:
    """Lines of text (value, file, start, id) with line, the number within the file, and load_ord, the number over all files in order of their names. Only the number of lines of each split is ordered as a whole."""
    lines = checkpointed(lines)
    splits = lines.groupBy("file", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = splits.select("file", "start", "first", before(W.partitionBy("file").orderBy("start")).alias("in_file"), before(W.orderBy("file", "start")).alias("in_all"))
    at = F.col("id") - F.col("first")
    return lines.join(placed, ["file", "start"]).select("value", "file", (F.col("in_file") + at + 1).alias("line"), (F.col("in_all") + at).alias("load_ord"))


def load_assertions(spark: SparkSession, path: str) -> DataFrame:
    """Assertions from JSON lines. Blank lines are skipped; the first line that isn't a whole record is an error that names file and line; the last of several records of one id counts."""
    rows = _assertion_lines(spark, path)
    bad = rows.where("bad").orderBy("load_ord").select("file", "line", "value").first()
    if bad is not None:
        raise ConfigError(f"{bad['file']}:{bad['line']}: not an assertion: {bad['value'][:80]}")
    return deduplicated(rows.select("r.*", "load_ord").drop("_bad"))


def scan_assertions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The same for a catalogue in use: the readable assertions, and an error row for each line that isn't one, by its id if it has one, else by file and line. A later record of an id doesn't hide that an earlier one is broken."""
    rows = _assertion_lines(spark, path)
    where = F.concat("file", F.lit(":"), F.col("line").cast("string"))
    subject = F.coalesce("r.assertion_id", F.get_json_object("value", "$.assertion_id"), where)
    errors = rows.where("bad").select(F.lit("assertions").alias("source"), subject.alias("subject_id"), F.concat(F.lit("not an assertion: "), where).alias("detail"))
    return deduplicated(rows.where("not bad").select("r.*", "load_ord").drop("_bad")), errors


def _assertion_lines(spark: SparkSession, path: str) -> DataFrame:
    try:
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    except Exception as error:
        raise ConfigError(f"{path}: {error}") from error
    schema = ASSERTIONS.replace(", load_ord bigint", ", _bad string")
    rows = _numbered(lines).where(F.trim("value") != "").select("load_ord", "file", "line", "value", F.from_json("value", schema, {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return rows.withColumn("bad", F.col("r._bad").isNotNull() | F.col("r.assertion_id").isNull() | F.col("r.status").isNull())


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class _SqliteReader(DataSourceReader):
    """Conditions column = value and column IN (values) go into the statement, which then runs once and by the table's index; without them a task reads a range of row ids."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.table, self.parts, self.names = options["path"], options["dbtable"], int(options.get("partitions", "8")), schema.names
        self.asked: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Spark checks all of them again, so that what SQLite takes for equal can't add a row."""
        for f in filters:
            values = f.value if isinstance(f, In) else (f.value,) if isinstance(f, EqualTo) else ()
            if values and len(values) <= MAX_ASKED and len(f.attribute) == 1 and f.attribute[0] in self.names and all(isinstance(v, str | int) for v in values):
                self.asked.append((f.attribute[0], tuple(values)))
            yield f

    def _connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[_Range]:
        if self.asked:
            return [_Range(None, None)]
        with self._connect() as c:
            low, high = c.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return []
        step = -(-(high - low + 1) // self.parts)
        return [_Range(x, min(x + step, high + 1)) for x in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        names = ", ".join(f'"{n}"' for n in self.names)
        if partition.low is None:
            where = " AND ".join(f'"{column}" IN ({", ".join("?" * len(values))})' for column, values in self.asked)
            given = tuple(v for _, values in self.asked for v in values)
        else:
            where, given = "rowid >= ? AND rowid < ?", (partition.low, partition.high)
        with self._connect() as c:
            yield from c.execute(f'SELECT {names} FROM "{self.table}" WHERE {where}', given)


class ReadOnlySqlite(DataSource):
    """Tables of a SQLite file, opened read-only: a range of row ids a task, or the rows of the ids asked for. The file has to be on every executor."""

    @classmethod
    def name(cls) -> str:
        return "readonly_sqlite"

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as c:
            found = c.execute(f'PRAGMA table_info("{self.options["dbtable"]}")').fetchall()
        if not found:
            raise ConfigError(f"{self.options['path']} has no table {self.options['dbtable']}")
        kinds = {"INTEGER": "bigint", "INT": "bigint", "REAL": "double", "BLOB": "binary"}
        return ", ".join(f"`{name}` {kinds.get(kind.upper(), 'string')}" for _, name, kind, *_ in found)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(dict(self.options), schema)


def sqlite_table(spark: SparkSession, path: str, table: str, columns: str | None = None) -> DataFrame:
    """A table, or only the columns that a schema names: others aren't read."""
    spark.dataSource.register(ReadOnlySqlite)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    read = spark.read.format("readonly_sqlite").option("path", path).option("dbtable", table)
    return (read.schema(columns) if columns else read).load()


def _tables_of(path: str) -> set[str]:
    try:
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
            return {name for (name,) in c.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
    except sqlite3.Error as error:
        raise ConfigError(f"{path}: {error}") from error


def evidence_records(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence from rows of evidence_id, record_json, redacted_at and redaction_reason, and an error row for each record that is no JSON of evidence or lacks its id or availability."""
    schema = EVIDENCE.replace(", redacted_at string, redaction_reason string", ", _bad string")
    parsed = rows.select(F.from_json("record_json", schema, {"columnNameOfCorruptRecord": "_bad"}).alias("r"), F.col("evidence_id").alias("held_as"), "redacted_at", "redaction_reason")
    parsed = parsed.withColumn("bad", F.col("r").isNull() | F.col("r._bad").isNotNull() | F.col("r.evidence_id").isNull() | F.col("r.availability").isNull())
    errors = parsed.where("bad").select(F.lit("evidence").alias("source"), F.col("held_as").alias("subject_id"), F.lit("not a record of evidence").alias("detail"))
    own = ("evidence_id", "_bad")
    fields = [F.col(f"r.{n}").alias(n) for n in parsed.schema["r"].dataType.names if n not in own]
    # The id is the store's own column, which the record repeats, so that a condition on it reaches the store.
    return parsed.where("not bad").select(F.col("held_as").alias("evidence_id"), *fields, "redacted_at", "redaction_reason"), errors


def candidate_errors(refs: DataFrame) -> DataFrame:
    """An error row for each candidate that has a reference of no known relationship: its references can't be read as a whole."""
    return refs.where(~F.coalesce(F.col("relationship").isin(*RELATIONSHIPS), F.lit(False))).select(F.lit("candidate_refs").alias("source"), "subject_id", F.lit("a reference has no known relationship").alias("detail")).distinct()


def registry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Evidence, from the table evidence(evidence_id, record_json[, redacted_at, redaction_reason]), candidate references, from candidate_refs(subject_id, evidence_id, relationship[, ord]) if there, and error rows."""
    names = _tables_of(path)
    if "evidence" not in names:
        raise ConfigError(f"{path} has no table evidence")
    rows = sqlite_table(spark, path, "evidence")
    extra = [c if c in rows.columns else None for c in ("redacted_at", "redaction_reason")]
    evidence, errors = evidence_records(rows.select("evidence_id", "record_json", *[F.col(c) if c else F.lit(None).cast("string").alias(n) for c, n in zip(extra, ("redacted_at", "redaction_reason"), strict=True)]))
    refs = None
    if "candidate_refs" in names:
        read = sqlite_table(spark, path, "candidate_refs")
        place = "ord" if "ord" in read.columns else F.monotonically_increasing_id()
        refs = read.withColumn("ord", (F.row_number().over(W.partitionBy("subject_id").orderBy(place)) - 1).cast("int")).select("subject_id", "ord", "evidence_id", "relationship")
        errors = errors.unionByName(candidate_errors(refs))
    return evidence, refs, errors


def audit(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The audit's records (seq, audit_id, record_json) and their references (audit_id, assertion_id), from tables of either of the names that are in use."""
    names = _tables_of(path)
    for records, refs in AUDIT_NAMES:
        if {records, refs} <= names:
            return sqlite_table(spark, path, records, AUDIT_RECORDS), sqlite_table(spark, path, refs, AUDIT_REFS)
    raise ConfigError(f"{path} has no tables {' and '.join(AUDIT_NAMES[0])}")


def from_parquet(spark: SparkSession, folder: str, max_depth: int = MAX_DEPTH) -> ProvenanceTables:
    """Tables from Parquet files named after them; optional ones may be missing. This is the layout for large data: scans prune columns and push filters."""

    def optional(name: str, schema: str) -> DataFrame | None:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        return spark.read.schema(schema).parquet(f"{folder}/{name}.parquet") if there else None

    return ProvenanceTables(
        spark.read.schema(ASSERTIONS).parquet(f"{folder}/assertions.parquet"), spark.read.schema(EVIDENCE).parquet(f"{folder}/evidence.parquet"),
        optional("candidate_refs", CANDIDATE_REFS), optional("audit_records", AUDIT_RECORDS), optional("audit_refs", AUDIT_REFS), max_depth,
        errors=optional("errors", ERRORS), lookups=frozenset(TABLES),
    )


def from_environment(spark: SparkSession, env: Mapping[str, str] | None = None) -> ProvenanceTables:
    """The tables that the environment names: ATTESTRA_FACTORY (module:function of the session) first, else ATTESTRA_EVIDENCE_DB and ATTESTRA_ASSERTIONS_JSONL, with ATTESTRA_AUDIT_DB and ATTESTRA_MAX_DEPTH if set."""
    env = os.environ if env is None else env
    if spec := env.get("ATTESTRA_FACTORY"):
        module, _, name = spec.partition(":")
        try:
            factory: Callable[[SparkSession], ProvenanceTables] = getattr(importlib.import_module(module), name)
        except (ImportError, AttributeError, ValueError) as error:
            raise ConfigError(f"ATTESTRA_FACTORY: {spec}: {error}") from error
        return factory(spark)
    database, lines = env.get("ATTESTRA_EVIDENCE_DB"), env.get("ATTESTRA_ASSERTIONS_JSONL")
    if not database or not lines:
        raise ConfigError("set ATTESTRA_FACTORY, or ATTESTRA_EVIDENCE_DB and ATTESTRA_ASSERTIONS_JSONL")
    depth = env.get("ATTESTRA_MAX_DEPTH", str(MAX_DEPTH))
    if not depth.isdecimal() or int(depth) < 1:
        raise ConfigError(f"ATTESTRA_MAX_DEPTH has to be a whole number of at least 1, not {depth!r}")
    evidence, refs, errors = registry(spark, database)
    records, links = audit(spark, env["ATTESTRA_AUDIT_DB"]) if env.get("ATTESTRA_AUDIT_DB") else (None, None)
    return ProvenanceTables(load_assertions(spark, lines), evidence, refs, records, links, int(depth), errors=errors, lookups=frozenset(TABLES) - {"assertions"})
