"""Analytics and search over append-only conversation logs, on Spark.

``sources`` read logs, ``functions`` work on text columns, ``operators`` on tables, ``plans`` put them together into
an index and a search, ``streaming`` refreshes an index as files arrive.
"""
