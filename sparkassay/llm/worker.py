"""State that outlives one task in a reused Python worker, and small helpers for Arrow tasks."""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Callable

from pyspark.sql import DataFrame

from sparkassay.session import give_back


def worker_cache(key: str, make: Callable[[], object]) -> object:
    """``make()`` once per Python worker and key; task code is sent by value and would forget it after each task."""
    holder = sys.modules.setdefault("_sparkassay_worker", types.ModuleType("_sparkassay_worker"))
    items = holder.__dict__.setdefault("items", {})
    if key not in items:
        items[key] = make()
    return items[key]


def forget_others(prefix: str) -> None:
    """Drop what operators of other keys keep in this Python worker: a stage needs no memory of the stage before it."""
    holder = sys.modules.get("_sparkassay_worker")
    items = holder.__dict__.get("items", {}) if holder else {}
    others = [key for key in items if not key.startswith(prefix)]
    for key in others:
        del items[key]
    if others:
        give_back()


def vocabulary_path(vocab: str) -> str:
    """An absolute path as it is; a bare name is looked up among the public tokenizer files of the worker."""
    if os.path.isabs(vocab):
        return vocab
    import public_tokenizers

    return str(public_tokenizers.path(vocab))


def spread(df: DataFrame) -> DataFrame:
    """At least one partition per core before CPU-heavy row work; a table with more splits than that stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
