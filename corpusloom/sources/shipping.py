"""Code that tasks run is sent along with the task.

Executors then need Arrow, but no installed copy of this package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship(module_name: str) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
