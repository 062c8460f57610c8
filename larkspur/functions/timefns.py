"""Time functions.  Stored times are ISO-8601 strings; now is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000
_AWARE = r"(Z|[+-]\d{2}:?\d{2})$"


def parse_aware(text: Column) -> Column:
    """A timestamp, or null for malformed text and for text without an offset."""
    return F.when(text.rlike(_AWARE), F.try_to_timestamp(text))


def age_micros(then: Column, as_of: Column) -> Column:
    return F.unix_micros(as_of) - F.unix_micros(then)


def age_days(then: Column, as_of: Column) -> Column:
    """Fractional days."""
    return age_micros(then, as_of) / F.lit(float(DAY_MICROS))


def floor_days(then: Column, as_of: Column) -> Column:
    """Whole days, rounded down (also below zero)."""
    return F.floor(age_micros(then, as_of) / F.lit(float(DAY_MICROS))).cast("long")


def day_of(text: Column) -> Column:
    """The date in the text's own offset: its prefix."""
    return F.substring(text, 1, 10)


def recency_factor(kind: Column, created: Column, indexed: Column, as_of: Column, half_life: float = 30.0, floor: float = 0.5) -> Column:
    """exp(-age / half_life), at least floor, for notes and summaries; else, and without a usable time, 1."""
    from larkspur.schema import RECENCY_BOOSTED

    then = parse_aware(F.coalesce(F.nullif(created, F.lit("")), indexed))
    return F.when(~kind.isin(*RECENCY_BOOSTED) | then.isNull() | kind.isNull(), F.lit(1.0)).otherwise(F.greatest(F.lit(floor), F.exp(-age_days(then, as_of) / F.lit(half_life))))


def plural(count: Column, word: str) -> Column:
    return F.concat(count.cast("string"), F.lit(f" {word}"), F.when(count != 1, "s").otherwise(""))


def duration_text(start: Column, end: Column) -> Column:
    """less than 1 hour, hours, days, weeks (under 30 days), months of 30 days; unknown."""
    micros = F.unix_micros(end) - F.unix_micros(start)
    days = F.floor(micros / F.lit(float(DAY_MICROS))).cast("long")
    hours = F.floor((micros - days * F.lit(DAY_MICROS)) / F.lit(3.6e9)).cast("long")
    return (
        F.when(micros.isNull(), "unknown")
        .when((days == 0) & (hours == 0), "less than 1 hour")
        .when(days == 0, plural(hours, "hour"))
        .when(days == 1, "1 day")
        .when(days < 7, F.concat(days.cast("string"), F.lit(" days")))
        .when(days < 30, plural(F.floor(days / 7).cast("long"), "week"))
        .otherwise(plural(F.floor(days / 30).cast("long"), "month"))
    )


def relative_text(then: Column, as_of: Column) -> Column:
    """just now, minutes, hours, days, weeks ago, then the date."""
    seconds = age_micros(then, as_of) / F.lit(1e6)
    ago = lambda unit, mark: F.concat(F.floor(seconds / unit).cast("long").cast("string"), F.lit(f"{mark} ago"))
    return F.when(then.isNull(), "").when(seconds < 60, "just now").when(seconds < 3600, ago(60, "m")).when(seconds < 86400, ago(3600, "h")).when(seconds < 604800, ago(86400, "d")).when(seconds < 2592000, ago(604800, "w")).otherwise(F.date_format(then, "MMM dd, yyyy"))


def display_date(then: Column) -> Column:
    return F.coalesce(F.date_format(then, "MMM dd, yyyy"), F.lit("Unknown"))


def last_activity(then: Column, as_of: Column) -> Column:
    days = floor_days(then, as_of)
    return F.when(days == 0, "Last activity: Today").when(days == 1, "Last activity: Yesterday").otherwise(F.concat(F.lit("Last activity: "), days.cast("string"), F.lit(" days ago")))
