"""quillmark: a PySpark-native engine for content catalogues."""

__version__ = "0.1.0"
