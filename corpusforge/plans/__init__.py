"""Queries over the tables, built from the operators."""

from corpusforge.plans import models, packing, tools, tuning  # noqa: F401
from corpusforge.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
