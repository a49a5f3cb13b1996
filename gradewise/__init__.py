"""gradewise: post-training data jobs (scoring, credit assignment, metrics,
batch algebra, balancing, puzzle corpora) as Spark DataFrame plans."""

import sys as _sys

try:  # ship our Python helpers with the UDFs that use them (no package install on executors)
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass
