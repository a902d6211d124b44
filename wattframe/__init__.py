"""Hourly energy time series as Spark DataFrames.

Every function takes and returns DataFrames; the ``series`` argument names the columns that tell
one time series from another (country, or country and year), so one plan covers all of them.
"""

from wattframe.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
