"""The registered queries of the evaluation-data operators and their SQL."""

from __future__ import annotations

from qaloom.plans import evaluation, lifecycle, streams, texts
from qaloom.plans.registry import Query
from qaloom.shipping import ship

_ALL = (evaluation.R, texts.R, lifecycle.R, streams.R)


def _shipped(query: Query) -> Query:
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {name: _shipped(q) for r in _ALL for name, q in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for r in _ALL for name, sql in r.sql.items()}
