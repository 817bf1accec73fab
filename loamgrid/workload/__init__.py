"""Queries registered for checking and timing, one per operator."""
from importlib import import_module

SECTIONS = ("listings", "joins", "aggregates", "retrieval", "texts", "upkeep", "messages", "streams")


def load():
    """Import every section and return (queries, oracle)."""
    for section in SECTIONS:
        import_module(f"{__name__}.{section}")
    from .registry import ORACLE, QUERIES
    return QUERIES, ORACLE
