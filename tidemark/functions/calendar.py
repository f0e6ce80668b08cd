"""Calendar columns of a date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_parts(date: Column) -> dict[str, Column]:
    """Month, Monday-based weekday, day of year, quarter, ISO week and three edge flags."""
    weekday, day = F.weekday(date), F.dayofmonth(date)
    return {
        "month": F.month(date),
        "day_of_week": weekday,
        "day_of_year": F.dayofyear(date),
        "quarter": F.quarter(date),
        "week_of_year": F.weekofyear(date),
        "is_weekend": (weekday >= 5).cast("int"),
        "is_month_start": (day <= 7).cast("int"),
        "is_month_end": (day >= 25).cast("int"),
    }
