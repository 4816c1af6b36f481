"""Vector retrieval and catalog control, declared as Spark plans."""

__version__ = "0.2.0"
