"""Training-data operators: toxicity, personal data, nearest neighbours, chat formatting, similarity join,
tokenizers, fingerprints, packing and WARC.  Nothing else in the library imports this subpackage.

Functions that run inside Spark tasks are pickled by value, so executors need
the public libraries they use (numpy, pyarrow, ...) but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
