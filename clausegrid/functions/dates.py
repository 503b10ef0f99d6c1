"""Date helpers as native Column expressions. The session time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid import constants as K
from clausegrid.functions.text import col


def as_date(value: str | Column) -> Column:
    return F.lit(value).cast("date") if isinstance(value, str) else value


def roll_business(date: Column | str) -> Column:
    """Saturday and Sunday move to the following Monday."""
    d = col(date)
    ahead = F.when(F.dayofweek(d) == 7, 2).when(F.dayofweek(d) == 1, 1).otherwise(0)
    return F.date_add(d, ahead)


def at_nine_local(ts: Column | str, tz: Column | str) -> Column:
    """09:00 of the instant's local calendar day, as an instant."""
    zone = col(tz)
    local_day = F.to_date(F.from_utc_timestamp(col(ts), zone))
    return F.to_utc_timestamp(local_day.cast("timestamp") + F.expr(f"INTERVAL {K.ALERT_HOUR} HOURS"), zone)


def due_band(due: Column | str, as_of: str | Column) -> Column:
    days = F.datediff(col(due), as_date(as_of))
    return (
        F.when(col(due).isNull(), "no date").when(days < 0, "overdue").when(days <= 7, "within 7 days")
        .when(days <= 31, "within 31 days").when(days <= 90, "within 90 days").otherwise("later")
    )


def offset_text(days: Column) -> Column:
    return (
        F.when(days == 0, F.lit("(same day)"))
        .when(days > 0, F.concat(F.lit("plus "), days.cast("string"), F.lit(" days")))
        .otherwise(F.concat(F.lit("minus "), F.abs(days).cast("string"), F.lit(" days notice")))
    )


def iso_date_in(text: Column | str) -> Column:
    """First ISO date written in a text, as a date."""
    found = F.regexp_extract(col(text), r"(\d{4})-(\d{2})-(\d{2})", 0)
    return F.when(found != "", F.try_to_date(found, "yyyy-MM-dd"))


def json_date(raw: Column | str) -> Column:
    """A date held as {"date": "..."} or as a JSON string; anything else is null."""
    raw = col(raw)
    from_object = F.get_json_object(raw, "$.date")
    from_string = F.when(raw.rlike(r'^\s*"[^"\\]*"\s*$'), F.regexp_extract(raw, r'"([^"\\]*)"', 1))
    return F.try_to_date(F.coalesce(from_object, from_string), "yyyy-MM-dd")


def written(fields: DataFrame) -> Column:
    """Order of writing among rows of one field: creation, prompt version and id, as far as the table has them."""
    return F.struct(*[F.col(c) for c in ("created_at", "prompt_version", "field_id") if c in fields.columns], F.col("value_text") if "value_text" in fields.columns else F.lit(0))
