"""Named queries over the driver's tables, one or more for each operator, each with its SQL where SQL can say it."""

from __future__ import annotations

from importlib import import_module

MODULES = ("tables", "scoring", "algebra", "networks", "connectors")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"matrel.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for m in MODULES for k, q in import_module(f"matrel.plans.{m}").SQL.items()}
