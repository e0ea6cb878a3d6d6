"""plainsift: a PySpark-native engine for file metadata, its removal and its verification."""

__version__ = "0.1.0"
