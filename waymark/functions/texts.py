"""Parsing of coordinate and time texts, and texts made from tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def nmea_angle(text: Column, hemisphere: Column) -> Column:
    """ddmm.mmmm or dddmm.mmmm with N, S, E or W; null if malformed."""
    whole = F.try_to_number(F.regexp_extract(text, r"^(\d{2,3})\d{2}(?:\.\d*)?$", 1), F.lit("999"))
    minutes = F.regexp_extract(text, r"^\d{2,3}(\d{2}(?:\.\d*)?)$", 1).try_cast("double")
    sign = F.when(hemisphere.isin("N", "E"), 1.0).when(hemisphere.isin("S", "W"), -1.0)
    return F.when(minutes < 60.0, (whole.cast("double") + minutes / 60.0) * sign)


def igc_angle(text: Column) -> Column:
    """DDMMmmmN or DDDMMmmmE: thousandths of minutes without a point."""
    degrees = F.regexp_extract(text, r"^(\d{2,3})\d{5}[NSEW]$", 1).try_cast("double")
    minutes = F.regexp_extract(text, r"^\d{2,3}(\d{5})[NSEW]$", 1).try_cast("double") / 1000.0
    sign = F.when(F.right(text, F.lit(1)).isin("S", "W"), -1.0).otherwise(1.0)
    return F.when(minutes < 60.0, (degrees + minutes / 60.0) * sign)


def cup_angle(text: Column) -> Column:
    """DDMM.mmmN or DDDMM.mmmE."""
    degrees = F.regexp_extract(text, r"^(\d{2,3})\d{2}\.\d{3}[NSEW]$", 1).try_cast("double")
    minutes = F.regexp_extract(text, r"^\d{2,3}(\d{2}\.\d{3})[NSEW]$", 1).try_cast("double")
    sign = F.when(F.right(text, F.lit(1)).isin("S", "W"), -1.0).otherwise(1.0)
    return F.when(minutes < 60.0, (degrees + minutes / 60.0) * sign)


def marked_angle(text: Column, positive: str, negative: str) -> Column:
    """A decimal number with a degree sign and a hemisphere letter, as in 50.08722ºN."""
    number = F.regexp_extract(text, rf"^([0-9.]+)[º°]?[{positive}{negative}]$", 1).try_cast("double")
    return number * F.when(F.right(text, F.lit(1)) == negative, -1.0).otherwise(1.0)


def day_number_time(days: Column) -> Column:
    """Days since the end of 1899 to a timestamp."""
    return F.timestamp_millis(F.round((days.cast("double") - 25569.0) * 86400000.0).cast("long"))


def template(pattern: str, tags: Column, keys: Sequence[str]) -> Column:
    """``{key}`` in a pattern replaced by the tag, missing tags by nothing."""
    out = F.lit(pattern)
    for key in keys:
        out = F.replace(out, F.lit("{" + key + "}"), F.coalesce(tags[key], F.lit("")))
    return out


def address(street: Column, postal_code: Column, city: Column, state: Column, country: Column) -> Column:
    """Lines of a postal address; empty parts are left out, the city never is."""

    def some(part: Column) -> Column:
        return F.when(part != "", part)

    town = F.concat_ws(" ", some(postal_code), F.coalesce(city, F.lit("")))
    return F.concat_ws("\n", some(street), town, some(state), some(country))
