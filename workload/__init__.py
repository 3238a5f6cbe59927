"""Registered queries over the driver tables."""

from __future__ import annotations

import importlib

MODULES = ("q_urls", "q_messages", "q_answers", "q_explain", "q_dataset", "q_models")


def all_queries():
    from workload.registry import QUERIES, SQL

    for m in MODULES:
        importlib.import_module(f"workload.{m}")
    return QUERIES, SQL
