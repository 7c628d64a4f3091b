"""Loads every plan module so that its queries are registered."""

from __future__ import annotations

import importlib

from sparkassay.plans.registry import ORACLES, QUERIES

MODULES = ("warehouse", "inputs", "text", "retrieval", "selection", "prompting", "parsing",
           "screening", "scoring", "runs", "curation", "live")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"sparkassay.plans.{name}")


def queries():
    _load()
    return dict(QUERIES)


def oracles():
    _load()
    return dict(ORACLES)
