"""codestrata: analytics over collections of source repositories, as PySpark DataFrame operators."""

__version__ = "0.1.0"
