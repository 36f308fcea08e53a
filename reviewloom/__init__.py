"""Review-aware top-N recommendation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Kernels travel to the executors whole, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from reviewloom.operators.recommend import ALGORITHMS, recommend  # noqa: E402
from reviewloom.session import build_session, durable  # noqa: E402

__all__ = ["ALGORITHMS", "recommend", "build_session", "durable"]
