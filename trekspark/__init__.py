"""Trajectory analytics and training-data operators as Spark DataFrame jobs."""

import os as _os
import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_root = _os.path.dirname(_os.path.dirname(_os.path.abspath(__file__)))
if _root not in _os.environ.get("PYTHONPATH", "").split(_os.pathsep):
    # Python workers would not find this package by name: send its functions themselves.
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
