"""Spark operators for locating and explaining extremes of a gridded measurement."""

from tailfield.session import get_session

__all__ = ["get_session"]
