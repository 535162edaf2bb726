"""Registered queries: each binds an operator to whole tables and pairs it with SQL where SQL can say it."""

from importlib import import_module

SECTIONS = ("scans", "quality", "joins", "aggregates", "series", "ordering", "sets", "scalars", "signals", "live", "statistics")


def load() -> None:
    for section in SECTIONS:
        import_module(f"echogrid.plans.{section}")
