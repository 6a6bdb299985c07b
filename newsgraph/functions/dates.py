"""Date functions and typed coercion."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The zone names of RFC 822 and the usual ones for UTC.
ZONES = {
    "GMT": "+0000", "UT": "+0000", "UTC": "+0000", "Z": "+0000",
    "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}

# optional weekday, day, month, year, time with optional seconds, optional zone
_FEED_DATE = (
    r"^\s*(?:[A-Za-z]+\.?,?\s+)?(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4}|\d{2})"
    r"\s+(\d{1,2}:\d{2})(:\d{2})?\s*([A-Za-z]+|[+-]\d{4})?\s*$"
)


def exact_timestamp(text: Column) -> Column:
    """Timestamp of a text that is exactly ``yyyy-MM-dd HH:mm:ss``, else null."""
    shaped = F.when(F.length(text) == 19, text)
    return F.try_to_timestamp(shaped, F.lit("yyyy-MM-dd HH:mm:ss"))


def feed_timestamp(text: Column) -> Column:
    """Timestamp of an RFC-822 date such as ``Mon, 05 Dec 2016 10:00:00 GMT``.

    Weekday, seconds and zone may be missing, days have one or two digits, years
    two or four; the zone is an offset or a name in ``ZONES``. No zone means UTC,
    whatever the session's time zone is. Any other text gives null, also one with
    an unknown zone.
    """
    # one pass of the pattern; it matches no text with a bar
    shape = F.split(F.regexp_replace(text, _FEED_DATE, "$1|$2|$3|$4|$5|$6"), r"\|")

    def built(parts: Column) -> Column:
        day, month, year, clock, seconds, zone = (F.get(parts, i) for i in range(6))
        full = F.when(F.length(year) == 4, year).when(year < "50", F.concat(F.lit("20"), year)).otherwise(
            F.concat(F.lit("19"), year))
        names = F.create_map(*(F.lit(x) for pair in ZONES.items() for x in pair))
        offset = F.when(zone == "", "+0000").when(zone.rlike("^[+-]"), zone).otherwise(F.try_element_at(names, F.upper(zone)))
        time = F.concat(clock, F.when(seconds == "", ":00").otherwise(seconds))
        shaped = F.concat(day, F.lit(" "), F.initcap(month), F.lit(" "), full, F.lit(" "), time, F.lit(" "), offset)
        return F.when(F.size(parts) == 6, F.try_to_timestamp(shaped, F.lit("d MMM yyyy H:mm:ss xx")))

    # the lambda binds the parts once
    return F.when(~text.contains("|"), F.get(F.transform(F.array(shape), built), 0))


def day_label(ts: Column) -> Column:
    return F.date_format(ts, "d MMM yyyy")


def clock_label(ts: Column) -> Column:
    return F.date_format(ts, "dd/MM/yyyy HH:mm:ss")


def to_int(text: Column) -> Column:
    return text.try_cast("int")


def to_bool(text: Column) -> Column:
    return text.try_cast("boolean")
