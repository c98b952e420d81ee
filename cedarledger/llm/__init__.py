"""Training-data operators: scoring, decontamination, tokenising, deduplication, personal data, language, quality.

Nothing else in the library imports this package; it can be deleted as a whole.
"""

import sys

from pyspark import cloudpickle

# Executors get these functions by value, so they need no copy of the repository on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
