"""Transport-operations analytics expressed as Spark DataFrame jobs."""

from depotlens.session import build_session, work_dir

__all__ = ["build_session", "work_dir"]
