"""Time as column expressions; stored times are naive UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def local(ts: Column, timezone: str) -> Column:
    """Naive UTC to naive local time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(timezone), ts)


def epoch(ts: Column) -> Column:
    """Seconds since 1970 of a naive UTC time, as a double."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def split_at_midnight(df: DataFrame, start: str, end: str) -> DataFrame:
    """Add date and seconds: an interval's pieces, one for each date that it touches (compat: by day of month).

    As the tools at hand do, an interval within one day of the month is one
    piece; else what lies before the end's midnight goes to the start's date."""
    s, e = F.col(start), F.col(end)
    seconds = lambda a, b: (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / F.lit(1e6)
    midnight = F.date_trunc("day", e)
    one = F.array(F.struct(F.to_date(s).alias("date"), seconds(s, e).alias("seconds")))
    two = F.array(
        F.struct(F.to_date(s).alias("date"), seconds(s, midnight).alias("seconds")), F.struct(F.to_date(e).alias("date"), seconds(midnight, e).alias("seconds"))
    )
    pieces = F.when(F.dayofmonth(s) == F.dayofmonth(e), one).otherwise(two)
    return df.withColumn("_piece", F.explode(pieces)).select("*", "_piece.*").drop("_piece")


def split_days(df: DataFrame, start: str, end: str) -> DataFrame:
    """Add date and seconds: a piece for each date from start to end; the seconds add up to the interval."""
    s, e = F.col(start), F.col(end)
    df = df.withColumn("date", F.explode(F.sequence(F.to_date(s), F.to_date(e), F.expr("interval 1 day"))))
    low = F.greatest(s, F.col("date").cast("timestamp_ntz"))
    high = F.least(e, F.date_add("date", 1).cast("timestamp_ntz"))
    return df.withColumn("seconds", (F.unix_micros(high.cast("timestamp")) - F.unix_micros(low.cast("timestamp"))) / F.lit(1e6))
