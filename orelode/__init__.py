"""Spark-first analytics and mining operators on DataFrames."""
