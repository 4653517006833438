"""playlake: Spark-native batch analytics for event-sequence data.

Operators take and return DataFrames; column names are parameters so the
same function serves the production schema and the test analog tables.
"""

import os as _os

# Native BLAS thread pools and the JVM's threads do not mix well in one
# process; Spark provides the parallelism, so keep BLAS single-threaded.
_os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
_os.environ.setdefault("OMP_NUM_THREADS", "1")

__version__ = "0.1.0"
