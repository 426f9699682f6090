"""Imports every catalog module once."""

from importlib import import_module

MODULES = ["quality_queries", "screening_queries", "trend_queries", "prognostic_queries", "evaluation_queries", "evidence_queries", "distributed_queries"]


def load_catalog() -> None:
    for m in MODULES:
        import_module(f"emberline.plans.{m}")
