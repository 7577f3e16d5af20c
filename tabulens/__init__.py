"""Profiling, anomaly marking and perception of tables as Spark DataFrame transformations."""
