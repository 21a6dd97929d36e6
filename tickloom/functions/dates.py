"""Trading-calendar and epoch helpers on date columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The date formats callers ask for by name.
DATE_FORMATS = {
    "standard": "MM/dd/yyyy",
    "iso": "yyyy-MM-dd",
    "compact": "yyyyMMdd",
    "month": "yyyy-MM",
}
# Spark numbers the days of the week from Sunday = 1 to Saturday = 7.
SUNDAY, SATURDAY = 1, 7
EXCHANGE_ZONE = "America/New_York"


def market_day(d: Column) -> Column:
    """The date itself, or the Friday before when it falls on a weekend."""
    day = F.dayofweek(d)
    return F.when(day == SATURDAY, F.date_sub(d, 1)).when(day == SUNDAY, F.date_sub(d, 2)).otherwise(d)


def next_market_day(d: Column) -> Column:
    """The date itself, or the Monday after when it falls on a weekend."""
    day = F.dayofweek(d)
    return F.when(day == SATURDAY, F.date_add(d, 2)).when(day == SUNDAY, F.date_add(d, 1)).otherwise(d)


def reference_dates(d: Column) -> dict[str, Column]:
    """Market days around ``d``, the date six months back, and their text forms and parts."""
    today, yesterday = market_day(d), market_day(F.date_sub(d, 1))
    tomorrow, half_year = next_market_day(F.date_add(d, 1)), F.add_months(d, -6)
    standard = DATE_FORMATS["standard"]
    return {
        "today_market": today,
        "yesterday_market": yesterday,
        "tomorrow_market": tomorrow,
        "six_months_ago": half_year,
        "today_text": F.date_format(today, standard),
        "yesterday_text": F.date_format(yesterday, standard),
        "tomorrow_text": F.date_format(tomorrow, standard),
        "six_months_ago_text": F.date_format(half_year, standard),
        "iso_text": F.date_format(d, DATE_FORMATS["iso"]),
        "compact_text": F.date_format(d, DATE_FORMATS["compact"]),
        "month_text": F.date_format(d, DATE_FORMATS["month"]),
        "current_month": F.date_format(d, "MM"),
        "current_day": F.date_format(d, "dd"),
        "current_year": F.date_format(d, "yyyy"),
        "from_month": F.date_format(half_year, "MM"),
        "from_day": F.date_format(half_year, "dd"),
        "from_year": F.date_format(half_year, "yyyy"),
    }


def epoch_to_date(seconds: Column) -> Column:
    """Epoch seconds to the exchange's local date (session zone UTC)."""
    return F.to_date(F.from_utc_timestamp(F.timestamp_seconds(seconds), EXCHANGE_ZONE))


def date_to_epoch(d: Column) -> Column:
    """Midnight of a date at the exchange, in epoch seconds (session zone UTC)."""
    return F.unix_seconds(F.to_utc_timestamp(d.cast("timestamp"), EXCHANGE_ZONE))
