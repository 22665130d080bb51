"""Operators that are more than one DataFrame call: aggregates, walks, versions."""
