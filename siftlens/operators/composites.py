"""Derived columns of picture, sound and film metadata: each is made where its inputs are, from values or from other derived
columns, and null where a required input is null. Columns are found by name; one that is absent counts as null."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlens.functions import datetime as dt
from siftlens.functions import numeric as nm
from siftlens.functions import text as tx


@dataclass(frozen=True)
class Composite:
    """What a column needs, what it may use (null where absent), and how it is made of these, in this order."""

    name: str
    require: tuple[str, ...]
    desire: tuple[str, ...]
    made: Callable[..., Column]


def _first(*given: Column) -> Column:
    return F.coalesce(*[F.when(x != 0, x) for x in given])


def _dated(day: Column, clock: Column) -> Column:
    return F.concat(day, F.lit(" "), clock)


def _signed(size: Column, ref: Column) -> Column:
    return F.when(ref.rlike("(?i)^[sw]"), -size).otherwise(size)


def _with_zone(text: Column, fraction: Column, zone: Column) -> Column:
    """A date with its fraction and offset; null where it has neither, as it is then the date itself."""
    full = F.concat(dt.with_fraction(text, fraction), F.coalesce(zone, F.lit("")))
    return F.when(F.coalesce(fraction, zone).isNotNull(), full)


ALL = [
    Composite("ImageSize", ("ImageWidth", "ImageHeight"), ("ExifImageWidth", "ExifImageHeight"), lambda w, h, ew, eh: F.concat_ws("x", F.coalesce(ew, w).cast("string"), F.coalesce(eh, h).cast("string"))),
    Composite("Megapixels", ("ImageSize",), (), lambda s: F.split(s, "x")[0].cast("double") * F.split(s, "x")[1].cast("double") / 1e6),
    Composite("ShutterSpeed", (), ("ExposureTime", "ShutterSpeedValue", "BulbDuration"), lambda e, s, b: F.coalesce(F.when(b > 0, b), e, s)),
    Composite("Aperture", (), ("FNumber", "ApertureValue"), _first),
    Composite("LightValue", ("Aperture", "ShutterSpeed", "ISO"), (), nm.light_value),
    Composite("ScaleFactor35efl", (), ("FocalLength", "FocalLengthIn35mmFormat", "FocalPlaneDiagonal"), nm.scale_to_35mm),
    Composite("FocalLength35efl", ("FocalLength",), ("ScaleFactor35efl",), lambda f, s: f * F.coalesce(s, F.lit(1.0))),
    Composite("CircleOfConfusion", ("ScaleFactor35efl",), (), nm.circle_of_confusion),
    Composite("HyperfocalDistance", ("FocalLength", "Aperture", "CircleOfConfusion"), (), nm.hyperfocal),
    Composite("DOF", ("FocalLength", "Aperture", "CircleOfConfusion"), ("FocusDistance", "SubjectDistance", "ObjectDistance", "ApproximateFocusDistance"), lambda f, a, c, *d: _depth(f, a, c, _first(*d))),
    Composite("FOV", ("FocalLength", "ScaleFactor35efl"), (), nm.field_of_view),
    Composite("GPSLatitude", ("GPSLatitudeValue", "GPSLatitudeRef"), (), _signed),
    Composite("GPSLongitude", ("GPSLongitudeValue", "GPSLongitudeRef"), (), _signed),
    Composite("GPSAltitude", ("GPSAltitudeValue",), ("GPSAltitudeRef",), nm.altitude),
    Composite("GPSPosition", ("GPSLatitude", "GPSLongitude"), (), lambda a, b: F.concat_ws(" ", a.cast("string"), b.cast("string"))),
    Composite("GPSDateTime", ("GPSDateStamp", "GPSTimeStamp"), (), lambda d, t: F.concat(_dated(d, t), F.lit("Z"))),
    Composite("DateTimeOriginal", (), ("DateTimeCreated", "DateCreated", "TimeCreated"), lambda both, d, t: F.coalesce(both, _dated(d, t))),
    Composite("DateTimeCreated", ("DateCreated", "TimeCreated"), (), _dated),
    Composite("DigitalCreationDateTime", ("DigitalCreationDate", "DigitalCreationTime"), (), _dated),
    Composite("SubSecDateTimeOriginal", ("ExifDateTimeOriginal",), ("SubSecTimeOriginal", "OffsetTimeOriginal"), _with_zone),
    Composite("SubSecCreateDate", ("CreateDate",), ("SubSecTimeDigitized", "OffsetTimeDigitized"), _with_zone),
    Composite("SubSecModifyDate", ("ModifyDate",), ("SubSecTime", "OffsetTime"), _with_zone),
    Composite("CFAPattern", ("CFARepeatPatternDim", "CFAPattern2"), (), lambda dim, cells: tx.cell_pattern(F.concat_ws(" ", dim, cells))),
    Composite("RedBalance", ("WB_RGGBLevels",), (), lambda x: nm.channel_balance(x, 0)),
    Composite("BlueBalance", ("WB_RGGBLevels",), (), lambda x: nm.channel_balance(x, 2)),
    Composite("FileNumber", ("DirectoryIndex", "FileIndex"), (), lambda d, f: F.format_string("%03d-%04d", d.cast("int"), f.cast("int"))),
    Composite("PreviewImageSize", ("PreviewImageWidth", "PreviewImageHeight"), (), lambda w, h: F.concat_ws("x", w.cast("string"), h.cast("string"))),
    Composite("Duration", (), ("SampleRate", "TotalSamples", "FrameRate", "FrameCount"), lambda r, n, fr, fn: F.coalesce(F.try_divide(n.cast("double"), r.cast("double")), F.try_divide(fn.cast("double"), fr.cast("double")))),
    Composite("AvgBitrate", ("MediaDataSize", "Duration"), (), lambda n, s: F.floor(F.try_divide(n * 8.0, s) + 0.5)),
    Composite("VolumeSize", ("VolumeBlockCount", "VolumeBlockSize"), (), lambda n, s: n * s),
    Composite("RunTimeSincePowerUp", ("RunTimeValue", "RunTimeScale"), (), lambda v, s: F.try_divide(v.cast("double"), s.cast("double"))),
]


def _depth(focal: Column, aperture: Column, confusion: Column, distance: Column) -> Column:
    near, far = nm.depth_of_field(focal, aperture, confusion, distance)
    return F.when(distance > 0, F.struct(near.alias("near"), far.alias("far")))


def with_composites(df: DataFrame, made: list[Composite] | None = None) -> DataFrame:
    """The table with the derived columns whose inputs it has, or that others give. A column that the table has already, or
    whose required inputs nothing gives, is not made; neither is one without any of its optional inputs."""
    left = [c for c in (ALL if made is None else made) if c.name not in df.columns]
    possible = {*df.columns}
    while more := {c.name for c in left if c.name not in possible and {*c.require} <= possible and ({*c.require} or {*c.desire} & possible)}:
        possible |= more
    left = [c for c in left if c.name in possible]
    while left:
        names = {c.name for c in left}
        ready = [c for c in left if not {*c.require, *c.desire} & (names - {c.name})]
        if not ready:
            raise ValueError(f"derived columns need each other: {sorted(names)}")
        have, out = {*df.columns}, {}
        for c in ready:
            inputs = [F.col(x) if x in have else F.lit(None) for x in (*c.require, *c.desire)]
            ok = F.lit(True)
            for x in c.require:
                ok = ok & F.col(x).isNotNull()
            out[c.name] = F.when(ok, c.made(*inputs))
        df = df.withColumns(out)
        left = [c for c in left if c.name not in out]
    return df
