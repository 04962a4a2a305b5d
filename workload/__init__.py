"""The registered queries: every operator on the given tables, with its SQL twin."""

from __future__ import annotations

from importlib import import_module

from workload.registry import ORACLES, QUERIES

MODULES = ("sources", "values", "names", "documents", "reconcile", "rollups", "inference", "release", "files")


def load() -> None:
    for module in MODULES:
        import_module(f"workload.{module}")


__all__ = ["QUERIES", "ORACLES", "load"]
