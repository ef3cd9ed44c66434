"""gridloom: a PySpark-native engine for electric-grid tables and analytics."""

__version__ = "0.1.0"
