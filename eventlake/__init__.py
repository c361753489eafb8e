"""Security and network event processing as PySpark DataFrame jobs."""

from eventlake.session import ensure_session

__all__ = ["ensure_session"]
