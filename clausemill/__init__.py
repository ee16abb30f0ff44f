"""clausemill: a PySpark-native engine for evidence-grounded document collections."""

__version__ = "0.1.0"
