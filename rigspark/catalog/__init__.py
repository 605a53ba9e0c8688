"""Every operator as a named query over the given tables."""

from __future__ import annotations

import importlib

from .base import ORACLES, QUERIES

_MODULES = ("ingest", "signal", "tables", "training", "linear", "decisions")


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f".{name}", __name__)


def queries():
    _load()

    def pinned(fn):
        def run(spark, sf_dir):
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        return run

    return {name: pinned(fn) for name, fn in QUERIES.items()}


def oracle_sql():
    _load()
    return dict(ORACLES)
