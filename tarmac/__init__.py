"""tarmac — flight-operations difficulty analytics on Spark DataFrames.

Every query is a function from Spark DataFrames to a Spark DataFrame built
from built-in operators, so Catalyst and AQE plan the work.  Layout:

* ``tarmac.sources``   — table schemas, readers, the stand-in tables and the sink
* ``tarmac.functions`` — Column helpers (time differences, ratios, labels)
* ``tarmac.operators`` — reusable relational building blocks (dedupe,
  fan-out-free join counts, hot-key join split, skew-safe ranking,
  one-row scalar attach)
* ``tarmac.plans``     — the named queries (cleaning, exploration, features,
  scoring, destination roll-ups) and the query catalog
* ``tarmac.streaming`` — incremental daily re-ranking over a stream of flights
"""

__version__ = "0.1.0"
