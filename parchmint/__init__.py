"""parchmint: document extraction, validation and evaluation as Spark plans."""

__version__ = "0.1.0"
