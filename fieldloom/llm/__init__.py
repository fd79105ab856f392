"""Training-data pipeline operators (language id, scoring, dedup, mixing, sharding).

Nothing else in the package imports this subpackage; ``__spark_entry__`` adds its
queries when it can be imported.
"""
