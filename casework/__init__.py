"""casework: a PySpark-native analytics engine for legal document collections."""

__version__ = "0.1.0"
