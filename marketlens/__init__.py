"""marketlens: product and marketing analytics as Spark DataFrame operators.

Subpackages
-----------
sources    staging adapter, schemas, readers and writers
functions  Column-expression helpers (exact decimal rounding, dates, statistics)
operators  DataFrame-in / DataFrame-out operators (marts, roll-up, features, ...)
streaming  Structured Streaming maintenance of the channel-month roll-up
plans      the registered queries and their DuckDB oracle SQL
"""

__version__ = "0.1.0"
