"""rolloutlab: Spark-native jobs for preparing code-generation training prompts,
scoring model completions and reporting on training history.

Every public function takes and returns DataFrames (or Columns), stays lazy and
never collects data to the driver.
"""

import sys

from rolloutlab.session import checkpoint_dir, get_spark

# Python functions that run inside tasks (the row-function surface, a pandas
# UDF term, the stateful stream processor) are serialised by value, so the
# Python workers need no installed copy of this package.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle without by-value support
    pass

__all__ = ["get_spark", "checkpoint_dir"]
