"""Every registered query and its DuckDB SQL."""

from plumbline.plans import assembly, corpus, extraction, facts, meaning, measures, projection, recording, relational, retrieval_tasks, structures  # noqa: F401  they register their queries
from plumbline.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
