"""The operators over the test tables, each beside plain SQL for the same result."""

from checks import (  # noqa: F401
    asof,
    control,
    cost,
    landing,
    performance,
    security,
    semantic,
    sizing,
    storage,
    streaming,
    users,
)
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
