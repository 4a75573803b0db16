"""Operators for preparing language-model training data.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it. Functions
of this subpackage travel to executors by value, so the package need not be
installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
