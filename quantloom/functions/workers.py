"""Functions that Python workers run."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def sent_whole(module: str) -> None:
    """Functions of a module go to workers with their code, so that workers find them without a path to this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
