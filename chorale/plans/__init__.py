"""Importing this package registers every query."""
import importlib
import pkgutil

from chorale.plans.registry import QUERIES, Query, query  # noqa: F401

for _module in pkgutil.iter_modules(__path__):
    importlib.import_module(f"{__name__}.{_module.name}")
