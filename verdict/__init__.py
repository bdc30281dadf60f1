"""verdict: Spark-native test-outcome analytics (DataFrame/SQL operators)."""

import sys

__version__ = "0.1.0"

# The few Python stages (applyInPandas / cogroup) use functions of this package.
# Pickle them by value so executors need no copy of the package on their path.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: ship the package with addPyFile instead
    pass
