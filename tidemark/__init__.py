"""Holdings-filing and insider-flow analytics as Spark DataFrame jobs."""

import os

# Spark runs the work side by side; in a process that also talks to Spark, threads of the linear algebra
# library under numpy have been seen to wait for each other for ever. It reads this when numpy is first imported.
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
