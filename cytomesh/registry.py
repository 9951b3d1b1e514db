"""All queries outside the llm subpackage, with their oracle SQL."""

from __future__ import annotations

from cytomesh.plans import folds, live, pixels, relational, spatial, survey, tables

QUERIES: dict = {**relational.QUERIES, **spatial.QUERIES, **folds.QUERIES, **live.QUERIES, **survey.QUERIES, **pixels.QUERIES, **tables.QUERIES}
ORACLE_SQL: dict[str, str] = {**relational.ORACLE_SQL, **spatial.ORACLE_SQL, **folds.ORACLE_SQL, **live.ORACLE_SQL, **survey.ORACLE_SQL, **pixels.ORACLE_SQL, **tables.ORACLE_SQL}
