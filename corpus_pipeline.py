"""The corpus pipeline: its stages, in order, and the whole run. See ``clauseframe.llm.pipeline``."""

from clauseframe.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
