"""As-of joins: interpolation between fixes, nearest values, clock drift.

All put probes and fixes into one table, ordered by key and time with fixes before probes, and fill from both sides: one
shuffle by key, a sort either way, no range join, and work in proportion to the rows of a key.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds between two fixes, and beyond the first or last, that still count.
WITHIN = 1800.0


def _bracketed(probes: DataFrame, fixes: DataFrame, keys: list[str], time: str, values: list[str], carry: list[str]) -> DataFrame:
    """Probes with the fix up to their time (t0, and its values) and the next fix after it (t1)."""
    a = probes.select(*keys, time, *carry, *[F.lit(None).cast(fixes.schema[v].dataType).alias(v) for v in values], F.lit(1).alias("is_probe"))
    b = fixes.select(*keys, time, *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in carry], *values, F.lit(0).alias("is_probe"))
    fix = F.when(F.col("is_probe") == 0, F.struct(F.col(time).alias("t"), *values))
    by = [time, "is_probe", *carry[:1]]
    # Both frames begin at the partition's start, so each is carried along: what lies ahead is looked at backwards.
    back = Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(*map(F.desc, by)).rowsBetween(Window.unboundedPreceding, -1)
    both = b.unionByName(a).withColumn("fix", fix)
    both = both.withColumn("f0", F.last("fix", ignorenulls=True).over(back)).withColumn("f1", F.last("fix", ignorenulls=True).over(ahead))
    return both.where("is_probe = 1").select(*keys, time, *carry, "f0", "f1")


def interpolate(probes: DataFrame, fixes: DataFrame, keys: list[str], time: str, values: list[str], carry: list[str], circular: dict[str, float] | None = None, within: float = WITHIN, beyond: float = WITHIN) -> DataFrame:
    """Probes with values from the fixes around them.

    Before the first or after the last fix, that fix counts if it is at most `beyond` away. Between two fixes at most
    `within` apart, values are interpolated linearly; along a circular value the shorter way, wrapped at the bound given
    for it. Between fixes farther apart, the nearest counts, the later one of two equally near, if it is at most
    `beyond` away. All else is null. time is in seconds; keys and time must not be null."""
    circular = circular or {}
    rows = _bracketed(probes, fixes, keys, time, values, carry)
    t, t0, t1 = F.col(time), F.col("f0.t"), F.col("f1.t")
    share = (t - t0) / (t1 - t0)
    near = F.when(t0.isNull(), F.lit(1)).when(t1.isNull(), F.lit(0)).otherwise(F.when(t - t0 < t1 - t, 0).otherwise(1))
    away = F.when(near == 0, t - t0).otherwise(t1 - t)

    def value(v: str) -> Column:
        a, b = F.col(f"f0.{v}").cast("double"), F.col(f"f1.{v}").cast("double")
        one = F.when(away <= beyond, F.when(near == 0, a).otherwise(b))
        if v in circular:
            a, b = F.when(b - a > 180, a + 360).otherwise(a), F.when(a - b > 180, b + 360).otherwise(b)
        between = a + (b - a) * share
        if v in circular:
            between = F.when(between >= circular[v], between - 360).otherwise(between)
        return F.when(t0.isNotNull() & t1.isNotNull() & (t1 - t0 <= within), between).otherwise(one).alias(v)

    return rows.select(*keys, time, *carry, *[value(v) for v in values])


def nearest(df: DataFrame, value: str, keys: list[str], time: str, *ties: str, within: float = WITHIN) -> Column:
    """The closest value that is not null, before or after, at most `within` away; the earlier of two equally near."""
    back_to = Window.partitionBy(*keys).orderBy(time, *ties).rowsBetween(Window.unboundedPreceding, 0)
    from_end = Window.partitionBy(*keys).orderBy(F.desc(time), *map(F.desc, ties)).rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col(value).isNotNull(), F.struct(F.col(time).alias("t"), F.col(value).alias("v")))
    a, b = F.last(own, ignorenulls=True).over(back_to), F.last(own, ignorenulls=True).over(from_end)
    back, ahead = F.col(time) - a["t"], b["t"] - F.col(time)
    early = b.isNull() | (back <= ahead)
    return F.when(a.isNotNull() & early & (back <= within), a["v"]).when(b.isNotNull() & ~(a.isNotNull() & early) & (ahead <= within), b["v"])


def drift_corrected(df: DataFrame, syncs: list[tuple[float, float]], time: str) -> Column:
    """A time less the clock's error, which changes linearly between the given points (time, error) and goes on so beyond
    the first and last; a single point gives a constant error. The points are a small fixed list."""
    points = sorted(syncs)
    t = F.col(time)
    if len(points) == 1:
        return t - points[0][1]

    def line(a: tuple[float, float], b: tuple[float, float]) -> Column:
        return F.lit(a[1]) + (t - a[0]) * ((b[1] - a[1]) / (b[0] - a[0]))

    error = line(points[-2], points[-1])
    for a, b in reversed(list(zip(points[:-2], points[1:-1], strict=True))):
        error = F.when(t < b[0], line(a, b)).otherwise(error)
    return t - error


def position_columns(fixes: DataFrame, keep: list[str], time: str = "t") -> DataFrame:
    """Rows of fixes (t, lat, lon, alt, and, where they have them, track, speed, dir, pitch, roll) as the columns a picture's
    position is written to: sizes with their references; what is null stays null."""
    have = {*fixes.columns}
    stamp = F.timestamp_seconds(F.col(time))
    ref = lambda c, below, above: F.when(F.col(c) < 0, F.lit(below)).when(F.col(c) >= 0, F.lit(above))
    out = [
        F.abs("lat").alias("GPSLatitude"), ref("lat", "S", "N").alias("GPSLatitudeRef"), F.abs("lon").alias("GPSLongitude"), ref("lon", "W", "E").alias("GPSLongitudeRef"),
        F.abs("alt").alias("GPSAltitude"), ref("alt", 1, 0).alias("GPSAltitudeRef"), F.date_format(stamp, "yyyy:MM:dd").alias("GPSDateStamp"), F.date_format(stamp, "HH:mm:ss").alias("GPSTimeStamp"),
    ]
    for own, name, mark in (("track", "GPSTrack", "T"), ("speed", "GPSSpeed", "K"), ("dir", "GPSImgDirection", "T")):
        if own in have:
            out += [F.col(own).alias(name), F.when(F.col(own).isNotNull(), F.lit(mark)).alias(f"{name}Ref")]
    out += [F.col(own).alias(name) for own, name in (("pitch", "GPSPitch"), ("roll", "GPSRoll")) if own in have]
    return fixes.select(*keep, *out)
