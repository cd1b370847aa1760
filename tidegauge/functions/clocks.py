"""Strict dates and clocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strict_date(text: Column | str) -> Column:
    """The date of a text of the form YYYY-MM-DD, else null."""
    c = _column(text)
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date"))


def strict_clock(text: Column | str) -> Column:
    """The instant of an ISO text that names its offset, else null."""
    c = _column(text)
    offset = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"
    return F.when(c.rlike(offset), F.regexp_replace(c, r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp"))


def seconds_between(earlier: Column | str, later: Column | str) -> Column:
    return _column(later).cast("timestamp").cast("double") - _column(earlier).cast("timestamp").cast("double")
