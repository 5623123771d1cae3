"""Derived trip features as native column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from punctual.functions.cleaning import strip_ws
from punctual.functions.common import ColumnOrName, flag, to_col

# Fixed values shared with the reference.
WEEKEND_DAYS = ["Saturday", "Sunday"]
WEEKEND_TOKENS = ["sat", "saturday", "sun", "sunday"]
RUSH_BUCKETS = ["Morning", "Evening"]
# Closed hour windows of the numeric rush-hour rule.
RUSH_HOURS = [(7.0, 9.0), (17.0, 19.0)]
# Closed minute windows (07:00-09:30, 16:30-19:00) of the departure-time rule.
RUSH_MINUTES = [(420, 570), (990, 1140)]
# Hour buckets: [5,12) Morning, [12,17) Afternoon, [17,21) Evening, else Night.
TIME_BUCKETS = [(5, 12, "Morning"), (12, 17, "Afternoon"), (17, 21, "Evening")]
NIGHT = "Night"
# Additive delay effects of the generated trips (minutes).
DELAY_EFFECTS = {
    "traffic_high": 5.0,
    "weather_dusty": 3.0,
    "weather_foggy": 4.0,
    "any_event": 2.0,
    "morning_peak": 2.0,   # 7 <= hour <= 9
    "evening_peak": 3.0,   # 17 <= hour <= 19
}
# Gaussian jitter (std) and clamps of the bootstrap expansion.
JITTER_STD = {"stop_distance_km": 0.05, "time_of_day": 0.08, "temperature_celsius": 0.2, "delay_minutes": 0.4}
JITTER_CLAMP = {"stop_distance_km": (0.5, 15.0), "time_of_day": (7.0, 22.0), "temperature_celsius": (24.0, 42.0)}
DEFAULT_ORIGIN = "rak"


def rush_hour_numeric(hour: ColumnOrName = "time_of_day") -> Column:
    """1 when 7<=h<=9 or 17<=h<=19; NULL/NaN -> 0."""
    h = to_col(hour)
    cond = None
    for lo, hi in RUSH_HOURS:
        part = (h >= F.lit(lo)) & (h <= F.lit(hi))
        cond = part if cond is None else cond | part
    return flag(~F.isnan(h) & cond)


def rush_hour_bucket(bucket: ColumnOrName = "time_of_day") -> Column:
    """1 for Morning or Evening buckets."""
    return flag(to_col(bucket).isin(*RUSH_BUCKETS))


def rush_hour_minutes(minutes: ColumnOrName = "departure_minutes") -> Column:
    """1 inside the closed minute windows; NULL -> 0."""
    m = to_col(minutes)
    cond = None
    for lo, hi in RUSH_MINUTES:
        part = (m >= F.lit(lo)) & (m <= F.lit(hi))
        cond = part if cond is None else cond | part
    return flag(cond)


def weekend_exact(day: ColumnOrName = "day_of_week") -> Column:
    """1 for exactly 'Saturday' or 'Sunday'."""
    return flag(to_col(day).isin(*WEEKEND_DAYS))


def weekend_casefold(day: ColumnOrName = "day_of_week") -> Column:
    """Case-folded match, also 'sat'/'sun'."""
    return flag(F.lower(to_col(day).cast("string")).isin(*WEEKEND_TOKENS))


def time_to_minutes(t: ColumnOrName = "departure_time") -> Column:
    """X6: 'HH:MM[:SS]' -> 60*HH + MM; NULL, one part, bad digits or more minutes than an int holds -> NULL."""
    parts = F.split(strip_ws(to_col(t).cast("string")), ":")
    hh = F.try_element_at(parts, F.lit(1)).try_cast("int")
    mm = F.try_element_at(parts, F.lit(2)).try_cast("int")
    return F.when(F.size(parts) >= 2, (hh.cast("bigint") * F.lit(60) + mm).try_cast("int"))


def time_bucket_from_hour(hour: ColumnOrName) -> Column:
    """Integer hour -> Morning/Afternoon/Evening/Night."""
    h = to_col(hour)
    out = F.lit(NIGHT)
    for lo, hi, name in reversed(TIME_BUCKETS):
        out = F.when((h >= lo) & (h < hi), F.lit(name)).otherwise(out)
    return out


def time_bucket_from_text(t: ColumnOrName = "departure_time") -> Column:
    """X7 on 'HH:MM' text: bucket of the hour before the colon."""
    hour = F.try_element_at(F.split(to_col(t).cast("string"), ":"), F.lit(1)).try_cast("int")
    return time_bucket_from_hour(hour)


def direction_from_route(route: ColumnOrName = "route", origin: str = DEFAULT_ORIGIN) -> Column:
    """No ' to ' -> Unknown; text before it equal to the origin -> From, else To."""
    low = F.lower(to_col(route).cast("string"))
    head = strip_ws(F.split_part(low, F.lit(" to "), F.lit(1)))
    return (F.when(~low.contains(" to ") | low.isNull(), F.lit("Unknown"))
             .when(head == F.lit(origin.lower()), F.lit("From"))
             .otherwise(F.lit("To")))


def normalise_time_text(t: ColumnOrName) -> Column:
    """X11: '5.30' -> '5:30'."""
    return F.replace(to_col(t).cast("string"), F.lit("."), F.lit(":"))


def clean_destination(d: ColumnOrName) -> Column:
    """Drop parentheses, strip."""
    return strip_ws(F.translate(to_col(d).cast("string"), "()", ""))


def is_digits(c: ColumnOrName) -> Column:
    """X13 check: non-empty ASCII digits only."""
    return F.coalesce(to_col(c).cast("string").rlike("^[0-9]+$"), F.lit(False))


def digits_to_int(c: ColumnOrName) -> Column:
    """X13 cast: digits-only text -> int, else NULL."""
    s = to_col(c).cast("string")
    return F.when(is_digits(s), s.try_cast("int"))


def additive_delay_effect(
    traffic: ColumnOrName = "traffic_condition",
    weather: ColumnOrName = "weather",
    event: ColumnOrName = "special_event",
    hour: ColumnOrName = "time_of_day",
    none_token: str | None = None,
) -> Column:
    """Sum of the additive effects in minutes.

    ``none_token`` names the text meaning 'no event' (e.g. 'None'); NULL
    always means no event.
    """
    ev = to_col(event)
    has_event = ev.isNotNull() if none_token is None else ev.isNotNull() & (ev != F.lit(none_token))
    h = to_col(hour)
    e = DELAY_EFFECTS
    return (
        F.when(to_col(traffic) == "High", F.lit(e["traffic_high"])).otherwise(F.lit(0.0))
        + F.when(to_col(weather) == "Dusty", F.lit(e["weather_dusty"]))
           .when(to_col(weather) == "Foggy", F.lit(e["weather_foggy"])).otherwise(F.lit(0.0))
        + F.when(has_event, F.lit(e["any_event"])).otherwise(F.lit(0.0))
        + F.when((h >= 7) & (h <= 9), F.lit(e["morning_peak"])).otherwise(F.lit(0.0))
        + F.when((h >= 17) & (h <= 19), F.lit(e["evening_peak"])).otherwise(F.lit(0.0))
    )


def clamp(c: ColumnOrName, lo: float | None, hi: float | None) -> Column:
    """Clip that keeps NULL and NaN (Spark's least/greatest would replace them)."""
    col = to_col(c)
    out = col
    if lo is not None:
        out = F.when(out < F.lit(float(lo)), F.lit(float(lo))).otherwise(out)
    if hi is not None:
        out = F.when(out > F.lit(float(hi)), F.lit(float(hi))).otherwise(out)
    return F.when(col.isNull() | F.isnan(col), col).otherwise(out)


def group_key(cols: Sequence[ColumnOrName], missing: str = "nan") -> Column:
    """Columns as text joined by '|'; missing -> 'nan' (concat_ws would drop it)."""
    return F.concat_ws("|", *[F.coalesce(to_col(c).cast("string"), F.lit(missing)) for c in cols])


def at_threshold(p: ColumnOrName, t: float = 0.5) -> Column:
    """1 when p >= t."""
    return flag(to_col(p) >= F.lit(float(t)))
