"""emberwatch: security-event analytics expressed as Spark jobs."""

from emberwatch.session import get_session

__all__ = ["get_session"]
