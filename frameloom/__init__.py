"""Image-sequence analytics on PySpark: frames, collections, statistics, tone maps."""

__version__ = "0.1.0"
