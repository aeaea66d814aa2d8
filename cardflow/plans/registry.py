"""All registered queries."""

from __future__ import annotations

from importlib import import_module

MODULES = ("history", "velocity", "relational", "metrics", "quality", "features", "io", "model")


def all_queries() -> dict:
    found = {}
    for name in MODULES:
        for key, pair in import_module(f"cardflow.plans.{name}").QUERIES.items():
            if key in found:
                raise ValueError(f"query {key} is registered twice")
            found[key] = pair
    return found
