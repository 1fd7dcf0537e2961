"""notelake: PySpark-native analytics over linked Markdown notes."""

__version__ = "0.1.0"
