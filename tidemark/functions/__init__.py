"""Aggregates and user functions."""

from .aggregates import Agg, aggregate
from .udf import FunctionRegistry

__all__ = ["Agg", "FunctionRegistry", "aggregate"]
