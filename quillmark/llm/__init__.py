"""Training-data operators. Nothing else in the package imports this folder."""

import sys

from pyspark import cloudpickle

# what runs inside tasks travels with them, so that executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules["quillmark.llm"])
