"""The corpus pipeline, for those who call it from here; its stages are in attestra/llm/pipeline.py."""

from attestra.llm.pipeline import COLUMNS, ORACLE_SQL, STAGES, run

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "run"]
