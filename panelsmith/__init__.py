"""Repeated-resampling feature selection and classifier evaluation on Spark."""

import sys

from pyspark import cloudpickle

from panelsmith.design import Design, K_LIST

__all__ = ["Design", "K_LIST"]

# Ship the package's own functions with the tasks, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
