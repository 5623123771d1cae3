"""punctual: trip-delay analytics on Spark.

Build trip tables, clean and label them, derive features, deduplicate,
split without leakage, train Spark ML classifiers and evaluate them with
distributed metric queries.
"""

__version__ = "0.1.0"
