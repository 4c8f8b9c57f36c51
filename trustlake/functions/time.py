"""Dates of epoch microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trustlake.config import DAY_US


def utc_date(us: Column) -> Column:
    """The UTC calendar day, independent of the session's time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(us / DAY_US).cast("int"))
