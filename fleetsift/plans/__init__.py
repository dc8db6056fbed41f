"""Runnable queries, one module per operator family."""

from importlib import import_module

MODULES: tuple[str, ...] = ("ingest", "detect", "parse", "comply", "fleet", "learn", "ledger", "corpus")


def load_all() -> None:
    """Import every family so that its queries are registered."""
    for name in MODULES:
        import_module(f"fleetsift.plans.{name}")
