"""Numbers and how they are shown, as Columns. Rounding is half away from zero."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _whole(x: Column) -> Column:
    return x.cast("long").cast("string")


def file_size(size: Column, largest: str = "MB") -> Column:
    """Bytes, or kB and MB by 1024: one digit after the point below ten of a unit. With "kB" as the largest unit, there
    are no MB. Halves are rounded away from zero before the number is written, as format_number takes the even digit."""

    def unit(by: float, name: str, digits: int) -> Column:
        return F.concat(F.format_number(F.round(size / by, digits), digits), F.lit(name)) if digits else F.concat(_whole(F.round(size / by)), F.lit(name))

    small = F.when(size < 2048, F.concat(_whole(size), F.lit(" bytes"))).when(size < 10240, unit(1024, " kB", 1))
    if largest == "kB":
        return small.otherwise(unit(1024, " kB", 0))
    return small.when(size < 2097152, unit(1024, " kB", 0)).when(size < 10485760, unit(1048576, " MB", 1)).otherwise(unit(1048576, " MB", 0))


def duration(seconds: Column) -> Column:
    """Seconds below half a minute with two digits, else [n days] h:mm:ss."""
    whole = F.floor(F.abs(seconds) + 0.5)
    sign = F.when(seconds < 0, F.lit("-")).otherwise(F.lit(""))
    days, hours = F.floor(whole / 86400), F.floor(whole / 3600)
    text = lambda h: F.concat(h.cast("string"), F.lit(":"), F.lpad((F.floor(whole / 60) % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))
    long_ = F.when(hours > 24, F.concat(days.cast("string"), F.lit(" days "), text(hours - days * 24))).otherwise(text(hours))
    short = F.concat(F.format_string("%.2f", F.abs(seconds)), F.lit(" s"))
    return F.when(seconds == 0, F.lit("0 s")).otherwise(F.concat(sign, F.when(F.abs(seconds) < 30, short).otherwise(long_)))


def bit_rate(rate: Column) -> Column:
    """bps, kbps, Mbps or Gbps by 1000, three digits at least."""
    power = F.when(rate < 1000, 0).when(rate < 1e6, 1).when(rate < 1e9, 2).otherwise(3)
    value = rate / F.pow(F.lit(1000.0), power)
    name = F.element_at(F.array(*map(F.lit, ("bps", "kbps", "Mbps", "Gbps"))), power + 1)
    return F.concat(F.when(value < 100, F.format_string("%.1f", value)).otherwise(_whole(F.round(value))), F.lit(" "), name)


def time_span(seconds: Column) -> Column:
    """The largest of days, hours, minutes and seconds that the span reaches, with one digit."""
    text = lambda by, name: F.concat(F.format_string("%.1f", seconds / by), F.lit(name))
    return F.when(seconds >= 86400, text(86400, " days")).when(seconds >= 3600, text(3600, " hours")).when(seconds >= 60, text(60, " minutes")).otherwise(F.concat(seconds.cast("string"), F.lit(" seconds")))


def fraction(value: Column) -> Column:
    """0, whole numbers, halves and thirds with a sign; all else with three significant digits."""
    shifted = value * 1.00001
    near = lambda by: (F.abs(shifted * by) - F.floor(F.abs(shifted * by))) < 0.001 * by
    whole = lambda by: F.when(shifted < 0, F.ceil(shifted * by)).otherwise(F.floor(shifted * by))
    sign = lambda n: F.when(n > 0, F.concat(F.lit("+"), n.cast("string"))).otherwise(n.cast("string"))
    return (
        F.when(value == 0, F.lit("0"))
        .when(near(1), sign(whole(1)))
        .when(near(2), F.concat(sign(whole(2)), F.lit("/2")))
        .when(near(3), F.concat(sign(whole(3)), F.lit("/3")))
        .otherwise(F.concat(F.when(value > 0, F.lit("+")).otherwise(F.lit("")), F.round(value, 3).cast("string")))
    )


def exposure_time(seconds: Column) -> Column:
    """1/n below a quarter second, else seconds with one digit, a zero left out."""
    return F.when((seconds > 0) & (seconds < 0.25001), F.concat(F.lit("1/"), F.floor(0.5 + 1 / seconds).cast("string"))).otherwise(F.regexp_replace(F.format_string("%.1f", seconds), r"\.0$", ""))


def light_value(aperture: Column, shutter: Column, iso: Column) -> Column:
    ok = (aperture > 0) & (shutter > 0) & (iso > 0)
    return F.when(ok, F.log2(aperture * aperture * 100 / (shutter * iso)))


def megapixels(width: Column, height: Column) -> Column:
    return width * height / 1e6


def circle_of_confusion(scale: Column) -> Column:
    """Of a format that is `scale` times smaller than 24 x 36 mm, in mm."""
    return F.sqrt(F.lit(24.0 * 24.0 + 36.0 * 36.0)) / (scale * 1440)


def hyperfocal(focal: Column, aperture: Column, confusion: Column) -> Column:
    """In m, from mm."""
    return F.try_divide(focal * focal, aperture * confusion * 1000)


def depth_of_field(focal: Column, aperture: Column, confusion: Column, distance: Column) -> tuple[Column, Column]:
    """Near and far limit in m; a far limit of 0 stands for infinity."""
    t = aperture * confusion * (distance * 1000 - focal) / (focal * focal)
    far = distance / (1 - t)
    return distance / (1 + t), F.when(far < 0, F.lit(0.0)).otherwise(far)


def field_of_view(focal: Column, scale: Column) -> Column:
    """Degrees across the longer side."""
    return F.degrees(2 * F.atan(36.0 / (2 * focal * scale)))


def dms(degrees: Column, seconds_digits: int = 2) -> Column:
    """Degrees, minutes and seconds of an angle's size; rounding carries over."""
    size = F.abs(degrees)
    total = F.round(size * 3600, seconds_digits)
    d = F.floor(total / 3600)
    m = F.floor((total - d * 3600) / 60)
    s = F.round(total - d * 3600 - m * 60, seconds_digits)
    return F.struct(d.cast("long").alias("d"), m.cast("long").alias("m"), s.alias("s"))


def from_dms(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """A signed angle; S and W are negative."""
    size = d + m / 60.0 + s / 3600.0
    return F.when(ref.rlike("(?i)^[sw]"), -size).otherwise(size)


def significant(value: Column, digits: int) -> Column:
    """Rounded to so many significant digits."""
    power = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(value))))
    return F.when(value == 0, F.lit(0.0)).otherwise(F.round(value * power) / power)


def thousands(value: Column) -> Column:
    """A whole number with commas between groups of three digits."""
    return F.format_number(value.cast("long"), 0)


def percent(part: Column, total: Column) -> Column:
    """A share in whole hundredths; null of nothing."""
    return F.round(F.try_divide(100.0 * part, total)).cast("long")


def rational(value: Column, most: int = 1000, steps: int = 24) -> Column:
    """The nearest fraction to a number, as n/d with d at most `most`: the last convergent of its continued fraction whose
    denominator fits, or the one that gives the number to within a part in 10^9."""
    size = F.abs(value)
    start = F.struct(
        size.alias("x"), F.lit(0.0).alias("n0"), F.lit(1.0).alias("n1"), F.lit(1.0).alias("d0"), F.lit(0.0).alias("d1"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        whole = F.floor(s["x"]).cast("double")
        n, d = whole * s["n1"] + s["n0"], whole * s["d1"] + s["d0"]
        over = s["done"] | (d > most)
        rest = s["x"] - whole
        done = over | (rest < 1e-9) | (F.abs(n / d - size) <= 1e-9 * size)
        keep = lambda old, new: F.when(over, old).otherwise(new)
        return F.struct(
            F.when(done, s["x"]).otherwise(F.try_divide(F.lit(1.0), rest)).alias("x"), keep(s["n0"], s["n1"]).alias("n0"), keep(s["n1"], n).alias("n1"),
            keep(s["d0"], s["d1"]).alias("d0"), keep(s["d1"], d).alias("d1"), done.alias("done"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, end["n1"].cast("long").cast("string"), F.lit("/"), end["d1"].cast("long").cast("string"))


def altitude(value: Column, below: Column) -> Column:
    """Metres, below the sea where the mark is 1 or tells so."""
    return F.when(F.coalesce(below.cast("string").rlike(r"^\s*(1|-|[Bb]elow)"), F.lit(False)), -value).otherwise(value)


def parameter(value: Column) -> Column:
    """A camera's setting: Normal for 0, a sign on other whole numbers."""
    return F.when(value == 0, F.lit("Normal")).when(value > 0, F.concat(F.lit("+"), value.cast("string"))).otherwise(value.cast("string"))


def channel_balance(levels: Column, channel: int) -> Column:
    """Of white-balance levels of four cells (red, green, green, blue), or of three, how far a channel is above the mean
    green; null where there are fewer or no green. channel: 0 red, 2 blue."""
    n = F.size(levels)
    green = F.when(n >= 4, (levels[1] + levels[2]) / 2.0).when(n == 3, levels[1].cast("double"))
    own = F.when(n >= 4, levels[3 if channel == 2 else 0]).when(n == 3, levels[channel])
    return F.try_divide(own.cast("double"), F.nullif(green, F.lit(0.0)))


def scale_to_35mm(focal: Column, focal35: Column, diagonal: Column) -> Column:
    """How many times longer a lens would be for the same view on 24 x 36 mm: from its stated equivalent, else from the
    sensor's diagonal in mm, where these are given and not zero."""
    whole = F.sqrt(F.lit(24.0 * 24.0 + 36.0 * 36.0))
    stated = F.when((focal > 0) & (focal35 > 0), focal35 / focal)
    return F.coalesce(stated, F.when(diagonal > 0, whole / diagonal))
