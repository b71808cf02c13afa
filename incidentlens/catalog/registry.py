"""Collect the queries of all catalog modules."""

from incidentlens.catalog import (
    cleaning, derivation, evaluation, explanation, history, learning, loading, profiling, reports)
from incidentlens.catalog.base import full_sql

MODULES = [loading, profiling, cleaning, reports, history, derivation, learning, evaluation, explanation]


def all_queries():
    out = {}
    for module in MODULES:
        out.update(module.QUERIES)
    return out


def all_oracles():
    out = {}
    for module in MODULES:
        for name, body in module.ORACLE.items():
            out[name] = full_sql(body, getattr(module, "EXTRA", None))
    return out
