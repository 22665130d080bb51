"""strataflow: rules, graph walks and Cypher over Spark DataFrames."""

__version__ = "0.1.0"
