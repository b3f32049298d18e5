"""Registered queries with the DuckDB text they must agree with."""

from __future__ import annotations

import importlib
import pkgutil

from plumbline.queries.base import REGISTRY, Query


def all_queries() -> dict[str, Query]:
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    return dict(REGISTRY)
