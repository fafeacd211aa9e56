"""Units and their texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed conversion factors from metres and metres a second.
FACTORS = {
    "km": 0.001,
    "mi": 0.00062137119223733,
    "nmi": 0.00053995680345572,
    "ft": 3.2808398950131,
    "km/h": 3.6,
    "mph": 2.2369362920544,
    "kn": 1.9438444924406,
    "ft/min": 196.85039370079,
    "m/min": 60.0,
}
#: Units of a system: of long and short distances, and how many short ones make a long one.
SYSTEMS = {"metric": ("km", "m"), "imperial": ("mi", "ft"), "nautical": ("nmi", "ft")}
_KM, _MI, _NMI = 1000.0, 1609.344, 1852.0
_LONG = {"metric": _KM, "imperial": _MI, "nautical": _NMI}


def converted(value: Column, unit: str) -> Column:
    return value * FACTORS[unit]


def fahrenheit(celsius: Column) -> Column:
    return celsius * 1.8 + 32.0


def distance_text(metres: Column, system: str = "metric") -> Column:
    """Short units under one long unit, two decimals under 10 (miles and more), else one."""
    long_unit, short_unit = SYSTEMS[system]
    value = metres / _LONG[system]
    short = metres if short_unit == "m" else converted(metres, "ft")
    return (
        F.when(value < 1, F.concat(F.format_string("%.0f", short), F.lit(f" {short_unit}")))
        .when(value < 10, F.concat(F.format_string("%.2f", value), F.lit(f" {long_unit}")))
        .otherwise(F.concat(F.format_string("%.1f", value), F.lit(f" {long_unit}")))
    )


def elevation_text(metres: Column, system: str = "metric") -> Column:
    value, unit = (metres, "m") if system == "metric" else (converted(metres, "ft"), "ft")
    return F.concat(F.format_string("%.0f", value), F.lit(f" {unit}"))


def speed_text(mps: Column, system: str = "metric") -> Column:
    unit = {"metric": "km/h", "imperial": "mph", "nautical": "kn"}[system]
    return F.concat(F.format_string("%.1f", converted(mps, unit)), F.lit(f" {unit}"))


def vertical_speed_text(mps: Column, system: str = "metric") -> Column:
    unit, value = ("m/s", mps) if system == "metric" else ("ft/min", converted(mps, "ft/min"))
    return F.concat(F.format_string("%.1f", value), F.lit(f" {unit}"))


def time_span_text(seconds: Column) -> Column:
    """hh:mm:ss, or mm:ss under an hour."""
    whole = F.floor(seconds)
    h, m, s = F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, s)).otherwise(F.format_string("%02d:%02d", m, s))


def _hemisphere(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.when(lat < 0, "S").otherwise("N"), F.when(lon < 0, "W").otherwise("E")


def decimal_text(lon: Column, lat: Column) -> Column:
    return F.format_string("%.5f, %.5f", lat, lon)


def degrees_minutes_text(lon: Column, lat: Column) -> Column:
    ns, ew = _hemisphere(lon, lat)

    def part(v: Column) -> Column:
        v = F.abs(v)
        return F.format_string("%d° %06.3f'", F.floor(v), (v - F.floor(v)) * 60.0)

    return F.concat(part(lat), ns, F.lit(", "), part(lon), ew)


def degrees_minutes_seconds_text(lon: Column, lat: Column) -> Column:
    ns, ew = _hemisphere(lon, lat)

    def part(v: Column) -> Column:
        v = F.abs(v)
        minutes = (v - F.floor(v)) * 60.0
        return F.format_string("%d° %02d' %04.1f\"", F.floor(v), F.floor(minutes), (minutes - F.floor(minutes)) * 60.0)

    return F.concat(part(lat), ns, F.lit(", "), part(lon), ew)


def nice_number(value: Column, rounded: bool = False) -> Column:
    """1, 2, 5 or 10 times a power of ten: the nearest, or the least that isn't smaller."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(value)))
    part = value / power
    if rounded:
        step = F.when(part < 1.5, 1.0).when(part < 3.0, 2.0).when(part < 7.0, 5.0).otherwise(10.0)
    else:
        step = F.when(part <= 1.0, 1.0).when(part <= 2.0, 2.0).when(part <= 5.0, 5.0).otherwise(10.0)
    return step * power


def ticks(low: Column, high: Column, count: int) -> Column:
    """struct<first, step, n>: nice ticks within a range, about ``count`` of them."""
    step = nice_number(nice_number(high - low) / float(count), rounded=True)
    first, last = F.ceil(low / step) * step, F.floor(high / step) * step
    return F.struct(first.alias("first"), step.alias("step"), (F.round((last - first) / step).cast("int") + 1).alias("n"))
