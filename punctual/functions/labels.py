"""Label expressions: Late = 1, On-Time = 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from punctual.functions.cleaning import strip_ws
from punctual.functions.common import ColumnOrName, flag, to_col

# Fixed values shared with the reference.
LATE_THRESHOLD_MINUTES = 5.0
LATE = "Late"
ON_TIME = "On-Time"


def late_from_delay(delay: ColumnOrName = "delay_minutes", threshold: float = LATE_THRESHOLD_MINUTES) -> Column:
    """1 when delay > threshold (strict); NULL or NaN delay -> 0."""
    d = to_col(delay)
    return flag(~F.isnan(d) & (d > F.lit(float(threshold))))


def late_from_status(status: ColumnOrName = "arrival_status") -> Column:
    """1 when the stripped, lower-cased status equals 'late' (P9 fallback)."""
    return flag(F.lower(strip_ws(to_col(status).cast("string"))) == F.lit("late"))


def late_from_status_substring(status: ColumnOrName = "arrival_status") -> Column:
    """1 when the lower-cased status contains 'late'; NULL -> 0 (P10)."""
    return flag(F.lower(to_col(status).cast("string")).contains("late"))


def late_from_status_exact(status: ColumnOrName = "arrival_status") -> Column:
    """1 when status equals 'Late' exactly."""
    return flag(to_col(status) == F.lit(LATE))


def status_text(label: ColumnOrName) -> Column:
    """1 -> 'Late', otherwise 'On-Time' (P12)."""
    return F.when(to_col(label) == 1, F.lit(LATE)).otherwise(F.lit(ON_TIME))
