"""Infrastructure telemetry analytics as ordinary PySpark DataFrame functions."""

from beaconry.session import build_session, cut_lineage, prepare

__all__ = ["build_session", "cut_lineage", "prepare"]
