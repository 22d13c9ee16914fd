"""Evidence checks on agent traces, and their evaluation, as Spark jobs."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the plan, so executors needn't have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
