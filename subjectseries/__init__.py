"""Per-subject time series and events on Spark DataFrames."""

from subjectseries.session import get_session, scratch_dir

__all__ = ["get_session", "scratch_dir"]
