"""Exact order statistics of groups of any size, without sorting a group.

The values' bits, arranged so that they order like the values, are counted 16 at
a time: a pass counts the values of each group by the next 16 bits, among those
that begin like the wanted element, and finds its bits by a running sum over at
most 65,536 counts. Four passes fix all 64 bits. Counts are summed before they
are shuffled, so neither a large group nor one with few distinct values is ever
in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STEP = 16
#: Parts of a group that meet what is known of it, each in a task.
SALTS = 64
_LOW = (1 << 63) - 1


def ordered_bits(value: Column) -> Column:
    """A long that orders like the double; -0.0 is 0.0, NaN is the largest."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + 0.0).cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(_LOW)))


def from_bits(bits: Column) -> Column:
    """The double of ``ordered_bits``."""
    raw = F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(_LOW)))
    return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), raw).cast("double")


def upper_medians(values: DataFrame, keys: list[str], value: str, out: str, spread: str | None = None) -> DataFrame:
    """(keys, out): element n / 2 of the n sorted values of each group, from 0; nulls don't count, groups of nulls alone have no row.

    The table is read once a pass: four times, and once to count. Keys mustn't be
    null. Where a group meets what is known of its element, its rows are dealt to
    SALTS parts by the column ``spread``, by default by their values.
    """
    salt = F.pmod(F.xxhash64(value if spread is None else spread), F.lit(SALTS)).alias("salt")
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    found = values.where(F.col(value).isNotNull()).groupBy(*keys).agg((F.floor(F.count("*") / 2) + 1).alias("place"))
    found = found.withColumn("prefix", F.lit(0).cast("long"))
    coded = values.where(F.col(value).isNotNull()).select(*keys, salt, ordered_bits(F.col(value)).alias("bits"))
    for shift in range(64 - _STEP, -1, -_STEP):
        part = F.shiftright("bits", shift).alias("part")
        if shift + _STEP < 64:
            like = coded.join(found.select(*keys, "prefix", salts), [*keys, "salt"]).where(F.shiftright("bits", shift + _STEP) == F.col("prefix"))
        else:
            like = coded
        counts = like.groupBy(*keys, part).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("part"))
        summed = counts.withColumn("upto", upto).join(found.select(*keys, "place"), keys)
        here = (F.col("upto") >= F.col("place")) & (F.col("upto") - F.col("n") < F.col("place"))
        found = summed.where(here).select(*keys, (F.col("place") - F.col("upto") + F.col("n")).alias("place"), F.col("part").alias("prefix"))
    return found.select(*keys, from_bits(F.col("prefix")).alias(out))
