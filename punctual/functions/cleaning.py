"""Value cleaning expressions (missing tokens, numeric coercion, dates)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from punctual.functions.common import ColumnOrName, to_col

# Fixed values that must equal the reference's for identical results:
# whitespace stripped around category text, and the texts that count as missing.
WHITESPACE_CLASS = "[ \\t\\n\\r\\f\\x0B]"
MISSING_TEXTS = ["nan", "NaN", "None", ""]
EVENT_MISSING_TOKEN = "NoEvent"
DEFAULT_MISSING_TOKEN = "Unknown"
ENCODE_MISSING_TOKEN = "NA"
NO_EVENT = "None"

# A plain decimal or scientific number, optionally signed and padded.
NUMERIC_PATTERN = "^[ \\t\\n\\r\\f]*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?[ \\t\\n\\r\\f]*$"


def strip_ws(c: ColumnOrName) -> Column:
    """Strip leading/trailing whitespace of any kind (Spark ``trim`` strips only spaces)."""
    return F.regexp_replace(to_col(c), f"^{WHITESPACE_CLASS}+|{WHITESPACE_CLASS}+$", "")


def clean_category(c: ColumnOrName, missing_token: str = DEFAULT_MISSING_TOKEN) -> Column:
    """NULL -> token; text form, stripped; 'nan'/'NaN'/'None'/'' -> token."""
    s = strip_ws(to_col(c).cast("string"))
    return F.when(s.isNull() | s.isin(*MISSING_TEXTS), F.lit(missing_token)).otherwise(s)


def clean_category_token(column_name: str) -> str:
    """Missing token by column: ``NoEvent`` for special_event, else ``Unknown``."""
    return EVENT_MISSING_TOKEN if column_name == "special_event" else DEFAULT_MISSING_TOKEN


def fill_event(c: ColumnOrName = "special_event") -> Column:
    """Missing event -> 'None' (P5)."""
    return F.coalesce(to_col(c).cast("string"), F.lit(NO_EVENT))


def safe_numeric(c: ColumnOrName) -> Column:
    """Coerce to double; non-numeric text, NaN and NULL -> NULL.

    The regex guard keeps ANSI casts from raising and rejects forms such
    as '5d' that Spark's cast would otherwise accept.
    """
    as_text = to_col(c).cast("string")
    # The pattern admits no 'NaN'/'inf' text, so the result is never NaN.
    return F.when(as_text.rlike(NUMERIC_PATTERN), strip_ws(as_text)).cast("double")


def nan_to_null(c: ColumnOrName) -> Column:
    col = to_col(c)
    return F.when(F.isnan(col), F.lit(None).cast("double")).otherwise(col)


def category_text(c: ColumnOrName, missing_token: str = ENCODE_MISSING_TOKEN) -> Column:
    """Category as text with one documented missing token."""
    return F.coalesce(to_col(c).cast("string"), F.lit(missing_token))


def parse_date(c: ColumnOrName) -> Column:
    """Date with coercion: unparseable -> NULL."""
    col = to_col(c)
    return F.coalesce(F.try_to_date(col.cast("string"), "yyyy-MM-dd"), F.to_date(F.try_to_timestamp(col.cast("string"))))


def iso_date(c: ColumnOrName) -> Column:
    """ISO text of a date."""
    return F.date_format(to_col(c), "yyyy-MM-dd")


def day_name(c: ColumnOrName) -> Column:
    """Full English day name of a date."""
    return F.date_format(to_col(c), "EEEE")
