"""Time arithmetic on TIMESTAMP_NTZ that no session time zone can bend.

Subtracting through TIMESTAMP would go by the session's zone, where a clock
change repeats or skips an hour.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

MICROS = 1000000


def epoch_micros(ts) -> Column:
    """Microseconds since 1970-01-01 00:00 on the same wall clock."""
    c = F.col(ts) if isinstance(ts, str) else ts
    minutes = F.unix_date(F.to_date(c)).cast("bigint") * 1440 + F.hour(c) * 60 + F.minute(c)
    return minutes * (60 * MICROS) + (F.extract(F.lit("SECOND"), c) * MICROS).cast("bigint")


def time_slice(ts, seconds: int) -> Column:
    """Number of the slice of the given width that holds the time."""
    return F.floor(epoch_micros(ts) / F.lit(seconds * MICROS))


def utc_clock(instant) -> Column:
    """TIMESTAMP_NTZ with the UTC wall clock of a TIMESTAMP, whatever the session's zone."""
    c = F.col(instant) if isinstance(instant, str) else instant
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def in_utc(df: DataFrame, ts: str = "ts") -> DataFrame:
    """df with a TIMESTAMP column turned into the UTC wall clock; a TIMESTAMP_NTZ one is that already."""
    if ts in df.columns and isinstance(df.schema[ts].dataType, TimestampType):
        return df.withColumn(ts, utc_clock(ts))
    return df
