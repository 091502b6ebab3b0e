"""Column-expression helpers (all built-in Spark functions, no UDFs)."""

from promolens.functions import dates, numeric, text

__all__ = ["dates", "numeric", "text"]
