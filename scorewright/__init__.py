"""Spark-first preparation of modelling data: sample, profile, recode, screen."""

from __future__ import annotations

import importlib

_WHERE = {"sample": "plans.sample", "recode": "plans.recode", "fit_recode": "plans.recode", "reduce_variables": "plans.reduce", "log_to": "sources.sinks", "Roles": "plans.config", "SampleConfig": "plans.config", "RecodeConfig": "plans.config", "ReduceConfig": "plans.config"}
__all__ = list(_WHERE)


def __getattr__(name: str):
    if name in _WHERE:
        return getattr(importlib.import_module(f".{_WHERE[name]}", __name__), name)
    raise AttributeError(name)
