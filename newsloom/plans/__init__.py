"""Registered queries over the derived views."""

from importlib import import_module

MODULES = ("ingest", "lists", "stories", "runs", "quality", "reports", "streams")


def load_registry():
    """All registered queries by name."""
    for name in MODULES:
        import_module(f"newsloom.plans.{name}")
    from newsloom.plans.registry import REGISTRY

    return REGISTRY
