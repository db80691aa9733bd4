"""Time arithmetic that does not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def interval_micros(interval: Column) -> Column:
    """A day-time interval as whole microseconds.

    Subtracting two zone-less timestamps gives an interval without going
    through the session zone, where a daylight-saving switch could turn a step
    forward into a step back.
    """
    days = F.extract(F.lit("DAY"), interval).cast("bigint")
    hours = F.extract(F.lit("HOUR"), interval).cast("bigint")
    minutes = F.extract(F.lit("MINUTE"), interval).cast("bigint")
    seconds = F.extract(F.lit("SECOND"), interval)
    whole_minutes = (days * 24 + hours) * 60 + minutes
    return whole_minutes * 60_000_000 + (seconds * 1_000_000).cast("bigint")
