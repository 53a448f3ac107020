"""Queries over the given tables, one per operator, each next to its SQL."""

import importlib
import pkgutil


def load():
    from checks import registry

    if not registry.QUERIES:
        for m in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("q_")):
            importlib.import_module(f"checks.{m}")
    return registry.QUERIES, registry.SQL
