"""The queries of this subpackage and their SQL twins."""
from __future__ import annotations

import corpus_pipeline

from . import queries as q


def queries() -> dict:
    return dict(q.QUERIES) | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in q.SQL.items() if v} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
