"""Import every query module; gives the filled registries."""

import suite.q_core  # noqa: F401
import suite.q_lake  # noqa: F401
import suite.q_parse  # noqa: F401
import suite.q_profile  # noqa: F401
from suite.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
