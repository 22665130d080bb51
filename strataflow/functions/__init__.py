"""Predicates and functions that programs can call, as Spark column expressions."""
