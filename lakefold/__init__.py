"""lakefold: a thin, Spark-first analytics engine.

Every operator returns a lazy DataFrame; planning, shuffling, spilling and code
generation are left to Spark.
"""
