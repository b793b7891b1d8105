"""The stages of `clausemill.llm.pipeline`, at the top of the repository."""

from clausemill.llm.pipeline import ORACLE_SQL, STAGES, drop_leaks, drop_near_copies, identify_language, pack_batches, redact_secrets, run

__all__ = ["ORACLE_SQL", "STAGES", "drop_leaks", "drop_near_copies", "identify_language", "pack_batches", "redact_secrets", "run"]
