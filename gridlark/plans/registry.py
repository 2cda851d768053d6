"""All queries by name, and the SQL that must give the same rows."""

from __future__ import annotations

from gridlark.plans import basics, forecast, roads, series, space

QUERIES = series.QUERIES | space.QUERIES | roads.QUERIES | forecast.QUERIES | basics.QUERIES
ORACLE = series.ORACLE | space.ORACLE | roads.ORACLE | forecast.ORACLE | basics.ORACLE
