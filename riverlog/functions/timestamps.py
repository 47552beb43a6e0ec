"""RFC 3339 text <-> timestamp, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the RFC 3339 date-time pattern.  A cast alone also takes bare dates.
RFC3339_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})\z"


def parse_rfc3339(text: Column) -> Column:
    """Timestamp of an RFC 3339 text, NULL for anything else."""
    return F.when(text.rlike(RFC3339_PATTERN), F.replace(text, F.lit(","), F.lit(".")).try_cast("timestamp"))


def utc_wall_clock(ts: Column) -> Column:
    """The UTC date and time of an instant as TIMESTAMP_NTZ."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.unix_micros(ts), epoch)


def rfc3339(ts: Column, zone: str = "UTC") -> Column:
    """RFC 3339 text with trailing fraction zeros trimmed, in ``zone``."""
    utc = utc_wall_clock(ts)
    if zone == "UTC":
        return F.concat(F.replace(utc.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))
    # One-item arrays bind the local time and its offset, so that the costly
    # conversion runs once per row and not once per mention.
    local = F.array(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc))
    timed = F.transform(
        local,
        lambda time: F.struct(
            F.replace(time.cast("string"), F.lit(" "), F.lit("T")).alias("text"),
            F.floor((micros(time, "timestamp_ntz") - F.unix_micros(ts)) / 60_000_000).alias("minutes"),
        ),
    )
    return F.transform(timed, lambda item: F.concat(item["text"], _offset(item["minutes"])))[0]


def _offset(minutes: Column) -> Column:
    size = F.abs(minutes)
    hours = F.lpad(F.floor(size / 60).cast("string"), 2, "0")
    rest = F.lpad((size % 60).cast("string"), 2, "0")
    signed = F.concat(F.when(minutes < 0, "-").otherwise("+"), hours, F.lit(":"), rest)
    return F.when(minutes == 0, "Z").otherwise(signed)


def watermark_text(ts: Column) -> Column:
    """Fixed-width UTC text with nine fraction digits, so that it sorts as time."""
    return F.concat(F.date_format(utc_wall_clock(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSS"), F.lit("Z"))


def micros(ts: Column, data_type: str = "timestamp") -> Column:
    """Microseconds since the epoch of a TIMESTAMP, or of a TIMESTAMP_NTZ in UTC."""
    if data_type == "timestamp_ntz":
        # By parts: a difference of wall clocks would pass through the session zone.
        seconds = (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
        minutes = F.hour(ts).cast("bigint") * 60 + F.minute(ts)
        return F.unix_date(ts.cast("date")).cast("bigint") * 86_400_000_000 + minutes * 60_000_000 + seconds
    return F.unix_micros(ts)
