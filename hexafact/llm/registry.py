"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from hexafact.llm import queries as q


def queries():
    return {**q.QUERIES, "pipeline": corpus_pipeline.run}


def oracle_sql():
    pipeline = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {**q.SQL, **pipeline}
