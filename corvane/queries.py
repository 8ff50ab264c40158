"""Every query of the engine by name, and the SQL that checks it."""

from corvane.plans.oracle import ORACLES
from corvane.plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
