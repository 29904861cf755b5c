"""Dates as `yyyy:MM:dd HH:mm:ss` text and as seconds, as Columns; the session's zone is UTC."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT = "yyyy:MM:dd HH:mm:ss"


def seconds_of(text: Column) -> Column:
    """Seconds since 1970 of a date text, with an optional offset or Z at its end; null where it isn't one."""
    base = F.unix_timestamp(F.try_to_timestamp(F.regexp_extract(text, r"^(\d{4}:\d\d:\d\d \d\d:\d\d:\d\d)", 1), F.lit(TEXT)))
    sign = F.regexp_extract(text, r"([+-])(\d\d):(\d\d)$", 1)
    hours, minutes = (F.try_to_number(F.nullif(F.regexp_extract(text, r"([+-])(\d\d):(\d\d)$", k), F.lit("")), F.lit("99")) for k in (2, 3))
    offset = F.when(sign == "", 0).otherwise((hours * 3600 + minutes * 60) * F.when(sign == "-", -1).otherwise(1))
    return base - offset.cast("long")


def text_of(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), TEXT)


def iso_seconds(text: Column) -> Column:
    """Seconds of an ISO-8601 time."""
    return F.try_to_timestamp(text).cast("double")


def shifted(year: Column, month: Column, day: Column, years: int = 0, months: int = 0, days: int = 0) -> Column:
    """A date moved by years and months, then by days. A day beyond the new month's end runs over into the next month."""
    total = year * 12 + (month - 1) + 12 * years + months
    first = F.make_date(F.floor(total / 12).cast("int"), (total % 12 + 1).cast("int"), F.lit(1))
    return F.date_add(first, (day - 1 + days).cast("int"))


def first_given(*texts: Column) -> Column:
    """The first of several dates that is given and not all zeros."""
    return F.coalesce(*[F.when(~t.rlike(r"^[0: ]*$"), t) for t in texts])


def with_fraction(text: Column, fraction: Column) -> Column:
    """A date text with its fraction of a second, where there is one."""
    digits = F.regexp_extract(fraction, r"^\s*(\d+)", 1)
    return F.when(F.coalesce(digits, F.lit("")) == "", text).otherwise(F.concat(text, F.lit("."), digits))


def edited(text: Column) -> Column:
    """An ISO date as a date text: dashes and T become colons and a space."""
    return F.regexp_replace(text, r"^(\d{4})-(\d\d)-(\d\d)[T ](\d\d:\d\d(?::\d\d)?)", "$1:$2:$3 $4")


def shifted_text(text: Column, by: str, back: bool = False) -> Column:
    """A date text moved by `Y:M:D h:m:s` (or, without a space, `h:m:s`), or back by it. Every component may be beyond its
    usual range and carries into the next; a day beyond its month's end runs over into the next month. Seconds may have
    a fraction on either side, which is shown as the text's own fraction is, or as the shift's."""
    sign = -1 if back else 1
    date, clock = by.split(" ", 1) if " " in by else ("0:0:0", by)
    years, months, days = (sign * int(x or 0) for x in (date.split(":") + ["0", "0"])[:3])
    hours, minutes, seconds = (sign * float(x or 0) for x in (clock.split(":") + ["0", "0"])[:3])
    part = lambda k: F.try_element_at(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)), F.lit(k)).cast("int")
    day = shifted(part(1), part(2), part(3), years, months, days)
    digits = F.regexp_extract(text, r"^\d+:\d+:\d+ \d+:\d+:\d+\.(\d+)", 1)
    given = len(by.rsplit(".", 1)[1]) if "." in by else 0
    places = F.greatest(F.length(digits), F.lit(given))
    # Thousandths of a millionth would not fit a timestamp's microseconds; six digits are kept.
    micros = F.unix_date(day).cast("long") * 86_400_000_000 + part(4) * 3_600_000_000 + part(5) * 60_000_000 + part(6) * 1_000_000
    micros = micros + F.rpad(digits, 6, "0").cast("long") + F.lit(round((hours * 3600 + minutes * 60 + seconds) * 1_000_000))
    whole = text_of(F.floor(micros / 1_000_000))
    rest = F.left(F.lpad(F.pmod(micros, F.lit(1_000_000)).cast("string"), 6, "0"), places)
    return F.when(places > 0, F.concat(whole, F.lit("."), rest)).otherwise(whole)


def all_shifted(df: DataFrame, columns: list[str], by: str, back: bool = False) -> DataFrame:
    """All date texts of some columns moved alike."""
    return df.withColumns({c: shifted_text(F.col(c), by, back) for c in columns})


# What conversion letters of C's strftime show, as patterns of dates.
_SHOWN = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a",
    "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy",
}


def strftime(seconds: Column, form: str, offset: Column | None = None) -> Column:
    """Seconds since 1970 as text in the form of C's strftime, with %s for the seconds and %z for an offset in minutes (0
    without one). What is no conversion stands for itself; an unknown conversion is an error."""
    stamp = F.timestamp_seconds(seconds if offset is None else seconds + offset * 60)
    parts, plain, at = [], "", 0
    while at < len(form):
        c, at = form[at], at + 1
        if c != "%" or at == len(form):
            plain += c
            continue
        c, at = form[at], at + 1
        if c == "%":
            plain += "%"
            continue
        if plain:
            parts.append(F.lit(plain))
            plain = ""
        if c == "s":
            parts.append(F.floor(seconds).cast("string"))
        elif c == "e":
            parts.append(F.lpad(F.dayofmonth(stamp).cast("string"), 2, " "))
        elif c == "z":
            parts.append(F.replace(zone_text(F.lit(0) if offset is None else offset), F.lit(":"), F.lit("")))
        elif c in _SHOWN:
            parts.append(F.date_format(stamp, _SHOWN[c]))
        else:
            raise ValueError(f"%{c} is not known")
    return F.concat(*parts, F.lit(plain))


def zone_text(minutes: Column) -> Column:
    """An offset from UTC as +hh:mm or -hh:mm."""
    size = F.abs(minutes)
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.concat(F.when(minutes < 0, F.lit("-")).otherwise(F.lit("+")), two(size / 60), F.lit(":"), two(size % 60))


def local_text(seconds: Column, minutes: Column) -> Column:
    """Seconds since 1970 as a date text in a zone so many minutes ahead of UTC, with the offset at its end."""
    return F.concat(text_of(seconds + minutes * 60), zone_text(minutes))


def loose_seconds(text: Column) -> Column:
    """Seconds of a date however its parts are separated: year, month and day, then, if given, hours and minutes and
    seconds; null where there is no such date."""
    form = r"^\s*(\d{4})\D?(\d{2})\D?(\d{2})(?:\D*(\d{2})\D?(\d{2})(?:\D?(\d{2}))?)?"
    part = lambda k: F.regexp_extract(text, form, k)
    clock = [F.when(part(k) == "", F.lit("00")).otherwise(part(k)) for k in (4, 5, 6)]
    return F.unix_timestamp(F.try_to_timestamp(F.concat(part(1), part(2), part(3), *clock), F.lit("yyyyMMddHHmmss")))


def gps_clock(hours: Column, minutes: Column, seconds: Column, digits: int = 0) -> Column:
    """Hours, minutes and seconds, any of which may have a fraction, as hh:mm:ss rounded to so many digits; what rounds up
    carries over."""
    unit = 10**digits
    total = F.round((hours * 3600.0 + minutes * 60.0 + seconds) * unit).cast("long")
    whole = F.floor(total / unit)
    two = lambda x: F.lpad(x.cast("long").cast("string"), 2, "0")
    shown = F.concat_ws(":", two(F.floor(whole / 3600)), two(F.floor(whole / 60) % 60), two(whole % 60))
    return F.concat(shown, F.lit("."), F.lpad((total % unit).cast("string"), digits, "0")) if digits else shown
