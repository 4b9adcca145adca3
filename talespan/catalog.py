"""Registered queries of the archive operators and their SQL."""

from talespan.plans.oracles import ORACLES
from talespan.plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
