"""Operators for preparing training text: filtering, de-duplication, scoring, redaction and packing.

Nothing else in the library imports this subpackage. Functions that run on executors are shipped
with the job, so executors need numpy, pyarrow, zstandard, the tokenizer library and its files.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
