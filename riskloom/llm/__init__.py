"""Operations of a training-data pipeline over ``documents`` and ``embeddings``.

Functions that run inside tasks are shipped by value, so that workers need no
copy of this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
