"""Imports every query module, so that the registry is complete."""

from importlib import import_module
from pkgutil import iter_modules

import touchline.plans as _plans
from touchline.plans.registry import QUERIES, checks

for _m in sorted(m.name for m in iter_modules(_plans.__path__) if m.name.startswith("q_")):
    import_module(f"touchline.plans.{_m}")

__all__ = ["QUERIES", "checks"]
