"""Column expressions: scalar helpers, aggregate expressions and unit constants."""

from towline.functions import aggregates, scalar, units

__all__ = ["aggregates", "scalar", "units"]
