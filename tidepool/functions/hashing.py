"""Seeded 64-bit priorities as column expressions; all arithmetic wraps at 64 bits."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the increment and the two multipliers of splitmix64, Fibonacci hashing's multiplier, and a second odd factor
GOLDEN, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
FIBONACCI, SECOND = 11400714819323198485, 7046029254386353131


def signed(x: int) -> Column:
    x &= (1 << 64) - 1
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """Expressions resolved inside wrap on overflow, whatever the session's ANSI mode."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def finalise(x: Column) -> Column:
    x = (x.bitwiseXOR(F.shiftrightunsigned(x, 30))) * signed(MIX_1)
    x = (x.bitwiseXOR(F.shiftrightunsigned(x, 27))) * signed(MIX_2)
    return x.bitwiseXOR(F.shiftrightunsigned(x, 31))


def by_index(index: Column, seed: int) -> Column:
    return finalise(index + signed(seed))


def by_time_and_channel(t: Column, channel: Column) -> Column:
    return finalise(t.bitwiseXOR(channel * signed(GOLDEN)))


def by_time(t: Column) -> Column:
    return finalise(t + signed(GOLDEN))


def by_product(t: Column, channel: Column) -> Column:
    return (t * signed(FIBONACCI)).bitwiseXOR(channel)


def by_two_products(t: Column, channel: Column) -> Column:
    return (t * signed(FIBONACCI)).bitwiseXOR(channel * signed(SECOND))


def unsigned_order(x: Column) -> Column:
    """A signed key that sorts as the unsigned value does."""
    return x.bitwiseXOR(signed(1 << 63))


def with_hash(df: DataFrame, name: str, make) -> DataFrame:
    """Add ``make()`` as a column under wrapping arithmetic."""
    with wrapping(df.sparkSession):
        return df.withColumn(name, make())
