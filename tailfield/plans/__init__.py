"""Registered queries over the given tables."""

import importlib

MODULES = (
    "source_queries", "label_queries", "grid_queries", "spatial_queries", "stat_queries", "profile_queries",
    "sampling_queries", "model_queries", "effect_queries", "window_queries", "jobs",
)


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"tailfield.plans.{name}")
