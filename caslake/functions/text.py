"""Formatting and parsing functions, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KIB = 1024


def hash_hex(h: Column) -> Column:
    return F.lower(F.hex(h))


def hash_short(h: Column, n: int = 8) -> Column:
    return F.coalesce(F.substring(hash_hex(h), 1, n), F.lit(""))


def hash_full(h: Column) -> Column:
    return F.coalesce(hash_hex(h), F.lit(""))


def hash_shard(h: Column) -> Column:
    return F.substring(hash_hex(h), 1, 2)


def hash_from_hex(s: Column) -> Column:
    """32 bytes of exactly 64 hex digits in either case, else null."""
    return F.when(s.rlike(r"\A[0-9A-Fa-f]{64}\z"), F.unhex(s))


def hash_valid(h: Column) -> Column:
    return F.coalesce(F.octet_length(h) == 32, F.lit(False))


def _rounded(n: Column, unit: int, places: int) -> Column:
    """n units to 1 or 2 decimals, half away from zero on the binary product; plain digits at any size, without zeros at the end but for the first decimal."""
    scaled = n / unit * float(10**places)
    low = F.floor(scaled)
    r = low + (scaled - low >= 0.5).cast("long")
    rest = r % 10**places
    if places == 2:
        rest = F.when(rest % 10 == 0, F.floor(rest / 10).cast("string")).otherwise(F.lpad(rest.cast("string"), 2, "0"))
    return F.concat(F.floor(r / 10**places).cast("string"), F.lit("."), rest.cast("string"))


def format_bytes(n: Column) -> Column:
    """The short form of the command line: B, KB and MB with one decimal, GB with two, binary thresholds."""
    return (
        F.when(n < KIB, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < KIB**2, F.concat(_rounded(n, KIB, 1), F.lit(" KB")))
        .when(n < KIB**3, F.concat(_rounded(n, KIB**2, 1), F.lit(" MB")))
        .otherwise(F.concat(_rounded(n, KIB**3, 2), F.lit(" GB")))
    )


def format_size(n: Column, largest: str = "PiB") -> Column:
    """The long form: B, then KiB to the largest unit with one decimal; '' for null."""
    units = ("KiB", "MiB", "GiB", "TiB", "PiB")
    top = units.index(largest)
    out = F.when(n.isNull(), F.lit("")).when(n < KIB, F.concat(n.cast("string"), F.lit(" B")))
    for k, unit in enumerate(units[:top], 1):
        out = out.when(n < KIB ** (k + 1), F.concat(_rounded(n, KIB**k, 1), F.lit(f" {unit}")))
    return out.otherwise(F.concat(_rounded(n, KIB ** (top + 1), 1), F.lit(f" {largest}")))


def _iso_date(us: Column) -> Column:
    """The UTC date of a moment, whatever the session's time zone; years are astronomical: 0 is 1 BC, and those before it have a sign and no zeros in front."""
    micros = F.lit(86_400_000_000)
    days = F.call_function("div", us, micros) - ((us < 0) & (us % micros != 0)).cast("long")
    day = F.date_from_unix_date(days.cast("int"))
    year = F.year(day).cast("string")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(F.when(F.year(day).between(0, 9999), F.lpad(year, 4, "0")).otherwise(year), F.lit("-"), two(F.month(day)), F.lit("-"), two(F.day(day)))


def relative_time(us: Column, now_us: Column | int) -> Column:
    now = F.lit(now_us) if isinstance(now_us, int) else now_us
    # null if the difference has more than 64 bits, which is long ago
    s = F.when(us > now, -F.expr("1L")).otherwise(F.floor(F.try_subtract(now, us) / 1_000_000))
    ago = lambda size, unit: F.concat(F.floor(s / size).cast("string"), F.lit(f"{unit} ago"))
    return (
        F.when(us.isNull(), F.lit("")).when(s < 5, F.lit("just now")).when(s < 60, ago(1, "s")).when(s < 3600, ago(60, "m")).when(s < 86_400, ago(3600, "h"))
        .when(s < 2_592_000, ago(86_400, "d")).when(s < 31_536_000, ago(2_592_000, "mo")).otherwise(_iso_date(us))
    )


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def sanitize_patterns(patterns: Column) -> Column:
    """Trimmed, without blanks and repeats; comment lines stay."""
    return F.array_distinct(F.filter(F.transform(patterns, _trim), lambda x: x != ""))


def parse_patterns(text: Column) -> Column:
    """The patterns of a text: a line each, without blanks, comments and repeats."""
    return F.filter(sanitize_patterns(F.split(text, r"\r?\n")), lambda x: ~x.startswith("#"))


def parse_id(text: Column) -> Column:
    """A whole number that isn't negative, or null."""
    return F.when(text.rlike(r"\A\+?[0-9]+\z"), text.try_cast("bigint"))


def pad_left(text: Column, width: int = 10) -> Column:
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, " "))


def live_line(kind: Column, path: Column, source: Column, to: Column) -> Column:
    """A line for an event as it comes; '' for kinds that aren't shown."""
    moved = F.concat(F.lit("↻  "), source, F.lit(" → "), to)
    marks = {"file_indexed": "+  ", "file_modified": "~  ", "file_deleted": "-  ", "location_added": "L+ ", "location_removed": "L- "}
    out = F.when(kind == "file_moved", moved)
    for k, mark in marks.items():
        out = out.when(kind == k, F.concat(F.lit(mark), path))
    return out.otherwise(F.lit(""))


def location_topic(location_id: Column) -> Column:
    return F.concat(F.lit("location:"), location_id.cast("string"))


def scan_topic(location_id: Column) -> Column:
    return F.concat(location_topic(location_id), F.lit(":scan"))
