"""Registered queries, one per operator, with their oracle SQL."""

from __future__ import annotations

import importlib

MODULES = ("periods", "audit", "profiles", "featuring", "splits", "selecting", "modelling", "scoring", "yearly", "deciding", "explaining")


def _load():
    from . import common

    for m in MODULES:
        try:
            importlib.import_module(f"{__name__}.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"{__name__}.{m}":
                raise
    return common


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLE)
