"""Names, civil times and epochs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE_SHIFT_SECONDS = 8 * 3600
ASSUMED_YEAR = "2025"


def micros(ts: Column) -> Column:
    """Timestamp (with or without zone) to BIGINT microseconds, session zone UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds(ts: Column) -> Column:
    return micros(ts) / F.lit(1_000_000)


def start_from_dirname(name: Column) -> Column:
    """``MMDDHHMM_user`` to ``MM.DD HH:MM``; NULL when the name has no such prefix."""
    pattern = r"^(\d{2})(\d{2})(\d{2})(\d{2})_"
    part = lambda i: F.regexp_extract(name, pattern, i)
    text = F.concat(part(1), F.lit("."), part(2), F.lit(" "), part(3), F.lit(":"), part(4))
    return F.when(name.rlike(pattern), text)


def date_label(start: Column, name: Column, strict: bool = True) -> Column:
    """struct(label, key) from a start time or, failing that, a name."""
    s, e = F.trim(F.coalesce(start, F.lit(""))), F.trim(F.coalesce(name, F.lit("")))
    full, short = r"^(\d{4})-(\d{2})-(\d{2})", r"^(\d{2})[.\-/](\d{2})\b"
    six, eight = r"^(\d{2})(\d{2})(\d{2})_", r"^(\d{2})(\d{2})\d{4}_"
    g = F.regexp_extract

    def out(label, y, m, d):
        key = y.cast("int") * 10000 + m.cast("int") * 100 + d.cast("int")
        return F.struct(label.alias("label"), key.alias("key"))

    def dashed(y, m, d):
        return F.concat_ws("-", y, m, d)

    c = (
        F.when(s.rlike(full), out(dashed(g(s, full, 1), g(s, full, 2), g(s, full, 3)),
                                  g(s, full, 1), g(s, full, 2), g(s, full, 3)))
        .when(s.rlike(short), out(F.concat_ws(".", g(s, short, 1), g(s, short, 2)),
                                  F.lit("2000"), g(s, short, 1), g(s, short, 2)))
        .when(e.rlike(six), out(dashed(F.concat(F.lit("20"), g(e, six, 1)), g(e, six, 2), g(e, six, 3)),
                                F.concat(F.lit("20"), g(e, six, 1)), g(e, six, 2), g(e, six, 3)))
        .when(e.rlike(eight), out(F.concat_ws(".", g(e, eight, 1), g(e, eight, 2)),
                                  F.lit("2000"), g(e, eight, 1), g(e, eight, 2)))
    )
    if not strict:
        return c
    return c.otherwise(F.raise_error(F.concat(F.lit("no date in start or name: "), s, F.lit(" / "), e)))


def civil_to_epoch(text: Column) -> Column:
    """Civil UTC+8 text ``yyyy-MM-dd HH:mm:ss`` to Unix seconds."""
    return (F.unix_timestamp(F.to_timestamp(text, "yyyy-MM-dd HH:mm:ss")) - ZONE_SHIFT_SECONDS).cast("double")


def epoch_to_civil(sec: Column) -> Column:
    """Unix seconds to civil UTC+8 text."""
    return F.date_format(F.timestamp_seconds(sec + ZONE_SHIFT_SECONDS), "yyyy-MM-dd HH:mm:ss")


def epoch_unit(scale: Column) -> Column:
    """Unit of an epoch column from its median: ns, ms or s."""
    return F.when(scale >= 1e14, "ns").when(scale >= 1e11, "ms").otherwise("s")


def to_seconds(epoch: Column, unit: Column) -> Column:
    return epoch / F.when(unit == "ns", 1e9).when(unit == "ms", 1e3).otherwise(1.0)


def short_civil(text: Column) -> Column:
    """``MM.dd HH:mm`` of the assumed year to a timestamp."""
    return F.to_timestamp(F.concat(F.lit(ASSUMED_YEAR + "."), text), "yyyy.MM.dd HH:mm")


def second_of(ts: Column) -> Column:
    return F.floor(ts).cast("long")
