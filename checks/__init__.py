"""Registered queries over the given tables, with SQL oracles."""

from importlib import import_module

MODULES = ["points", "summaries", "lines", "motion", "nearby", "images", "tracking", "finder", "edits"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"checks.{name}")
