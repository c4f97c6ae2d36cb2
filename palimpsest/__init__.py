"""palimpsest: text-reuse detection as Spark DataFrame plans."""

__version__ = "0.1.0"
