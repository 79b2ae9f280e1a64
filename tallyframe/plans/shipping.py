"""Functions that run on workers."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def by_value(module: str) -> None:
    """Ship the functions of a module inside the task, so that workers need not have the library installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
