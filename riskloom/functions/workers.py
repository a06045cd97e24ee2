"""Functions that run in Python workers."""

from __future__ import annotations

from types import ModuleType

from pyspark import cloudpickle


def by_value(*modules: ModuleType) -> None:
    """Send these modules along with the functions that use them, so that executors
    need no copy of the package."""
    for module in modules:
        cloudpickle.register_pickle_by_value(module)
