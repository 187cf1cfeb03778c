"""All registered queries."""

from __future__ import annotations

import importlib

from oscilla.plans.registry import ORACLES, PLANS, Plan

MODULES = ["ingest", "cohort_reports", "signals", "statistics", "landmark_plans", "selection", "report_steps", "files", "end_to_end"]


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"oscilla.plans.{module}")


def plans() -> dict[str, Plan]:
    _load()
    return dict(PLANS)


def oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
