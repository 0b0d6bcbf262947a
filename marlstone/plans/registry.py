"""Every query over the driver's tables, and its SQL."""

from marlstone.plans import chains, findings, logs, relations, rules, scalars, selecting, sql, tables, timed  # noqa: F401
from marlstone.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
