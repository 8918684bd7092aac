"""Market ticks and the news around them, as Spark DataFrame operators."""

__version__ = "0.1.0"
