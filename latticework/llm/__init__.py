"""Operators for training-data pipelines. Nothing outside this subpackage imports it."""

from __future__ import annotations

import importlib

_QUERY_MODULES = ("q_overlap", "q_neighbours", "q_sampling", "q_subset", "q_packing", "q_mixing", "q_residue")


def query_modules() -> list:
    return [importlib.import_module(f"{__name__}.{n}") for n in _QUERY_MODULES]
