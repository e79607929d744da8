"""Queries over the driver tables, one module per operator family."""

from importlib import import_module

FAMILIES = ["report", "browse", "functions", "lines", "quality", "matching", "evaluation", "texts", "intake"]


def load() -> None:
    for name in FAMILIES:
        import_module(f"{__name__}.{name}")
