"""All queries over the composition tables, by name, and their SQL."""

from __future__ import annotations

from functools import partial

from masschain.operators import cells, facts, fixpoint, graph, grounding, heights, joins, lookups, materials, periods, phrases, plugins, questions, rollup, rules, sampling, search, selection, served, textlog, unknowns, vectors
from masschain.sources import corpus, files
from masschain.streaming import incremental, sources

from . import view
from .tables import CHECK_CTES, sql_query, with_ctes

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

for _part in (cells, facts, joins, lookups, questions, rollup, rules, sampling, served, textlog):
    for _name, _body in _part.SQL.items():
        _spark, _ansi = _body if isinstance(_body, tuple) else (_body, _body)
        QUERIES[_name] = sql_query(_spark)
        ORACLE_SQL[_name] = with_ctes(_ansi, CHECK_CTES)

QUERIES |= graph.QUERIES | fixpoint.QUERIES | grounding.QUERIES | heights.QUERIES | materials.QUERIES | periods.QUERIES | phrases.QUERIES | selection.QUERIES | corpus.QUERIES | files.QUERIES | plugins.QUERIES | incremental.QUERIES | sources.QUERIES | search.QUERIES | unknowns.QUERIES | vectors.QUERIES
ORACLE_SQL |= {k: with_ctes(v, CHECK_CTES) for k, v in (graph.ORACLE | materials.ORACLE | unknowns.ORACLE | fixpoint.ORACLE | grounding.ORACLE | heights.ORACLE | periods.ORACLE | phrases.ORACLE | selection.ORACLE | corpus.ORACLE | files.ORACLE | plugins.ORACLE | search.ORACLE | incremental.ORACLE | sources.ORACLE).items()}
ORACLE_SQL |= plugins.FULL_ORACLE

# what stands above leaf slices starts from the served leaves
QUERIES["parent_gate"] = partial(view.above_leaves, body=rollup.SQL["parent_gate"])
