"""Registered queries, their fixture views and their SQL twins."""

from importlib import import_module

MODULES = ("tracks", "meetings", "voyages", "sensing")


def load_all() -> None:
    """Imports every module that registers queries."""
    for name in MODULES:
        import_module(f"icefathom.plans.{name}")
