"""Queries over the supplied tables, each with the SQL that checks it."""

from importlib import import_module

MODULES = (
    "reads",
    "relations",
    "sequences",
    "alerting",
    "ingest",
    "inventory",
    "streams",
)


def load():
    """Every registered query and every checking statement."""
    for module in MODULES:
        import_module(f"beaconry.plans.{module}")
    from beaconry.plans.registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
