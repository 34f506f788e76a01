"""Training-data operators. Nothing outside this folder imports it.

Spark gives a task one core, so numpy's linear algebra stays on one thread.
"""

import os

for _name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
    os.environ.setdefault(_name, "1")
