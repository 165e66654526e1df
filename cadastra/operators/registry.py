"""Every declarative operator, by module."""

from __future__ import annotations

from cadastra.operators import aggregates, arrivals, checks, dml, enrichment, explanations, extracts, filters, gate, joins, lookups, portal, programs, records, sampling, scalars, scoring, search, states, text_rules, windows
from cadastra.plans.operator import Operator, registry

OPERATORS: list[Operator] = [o for m in (filters, joins, aggregates, windows, scoring, scalars, dml) for o in m.OPERATORS]
QUERIES, ORACLE_SQL = registry(OPERATORS)
QUERIES |= programs.QUERIES
ORACLE_SQL |= programs.ORACLE_SQL
for _rules in (records, search, enrichment, gate, explanations, sampling, extracts, states, checks, arrivals, text_rules, portal, lookups):
    QUERIES |= _rules.QUERIES
    ORACLE_SQL |= _rules.ORACLE_SQL
BY_NAME = {o.name: o for o in OPERATORS}
