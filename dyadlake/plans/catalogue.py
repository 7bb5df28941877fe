"""The registered queries on the reference's operators, each with its SQL."""

from __future__ import annotations

import importlib

MODULES: list[str] = ["pair_plans", "metric_plans", "scope_plans", "table_plans", "solver_plans"]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in importlib.import_module(f"dyadlake.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: f for m in MODULES for k, f in importlib.import_module(f"dyadlake.plans.{m}").SQL.items()}
