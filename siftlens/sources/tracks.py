"""Track logs as fixes: GPX, KML, Garmin XML, NMEA sentences, IGC, and two plain text forms. Text is split by expressions in the JVM; what depends on
the order of lines (a log's date) is carried along by a window within the log."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlens.functions.datetime import iso_seconds

#: What every reader gives: where and when, how it moved, how it was held, how good the fix is; null where a log says nothing.
PLACE = ("track_id", "t", "lat", "lon", "alt")
FIX = (*PLACE, "track", "speed", "dir", "pitch", "roll", "pdop", "hdop", "nsats")
#: Kilometres an hour of a knot.
KNOT = 1.852


def _whole(fixes: DataFrame) -> DataFrame:
    """Fixes with all columns, and none without a time."""
    have = {*fixes.columns}
    kind = lambda c: "int" if c == "nsats" else "double"
    return fixes.select("track_id", *[(F.col(c) if c in have else F.lit(None)).cast(kind(c)).alias(c) for c in FIX[1:]]).where("t is not null")


def log_kind(text: Column) -> Column:
    """What a log is, told by its beginning."""
    top = F.substring(text, 1, 4000)
    return (
        F.when(top.rlike(r"(?i)<gpx\b"), "GPX").when(top.rlike(r"(?i)<kml\b"), "KML").when(top.rlike("<(TrainingCenterDatabase|Trackpoint|trk)"), "XML")
        .when(top.rlike(r"(?m)^\$(GP|GN)(RMC|GGA|GLL|ZDA)"), "NMEA").when(top.rlike(r"(?m)^\$(PMGNTRK|PTNTHPR)"), "NMEA")
        .when(top.rlike(r"(?m)^TP,D,"), "Winplus").when(top.rlike(r"(?m)^\s*\d+(\s+\S+){10}\s+ypr\s*$"), "Bramor").when(top.rlike(r"(?m)^A(FLA|XSB|[A-Z]{3})"), "IGC")
    )


def _double(text: Column) -> Column:
    return F.nullif(text, F.lit("")).try_cast("double")


def _inside(text: Column, tag: str) -> Column:
    return F.regexp_extract(text, rf"(?is)<{tag}\b[^>]*>\s*([^<]*?)\s*</{tag}>", 1)


def gpx(logs: DataFrame, text: str = "value", track: str = "path") -> DataFrame:
    """Fixes of GPX points (path, value): time, latitude, longitude, altitude."""
    points = F.regexp_extract_all(F.col(text), F.lit(r"(?is)(<(?:trkpt|wpt|rtept)\b.*?</(?:trkpt|wpt|rtept)>)"), F.lit(1))
    p = logs.select(F.col(track).alias("track_id"), F.explode(points).alias("p"))
    place = lambda a: _double(F.regexp_extract("p", rf'(?i)\b{a}\s*=\s*["\']([^"\']*)', 1))
    extra = {"track": "course", "speed": "speed", "pdop": "pdop", "hdop": "hdop", "nsats": "sat"}
    more = [_double(_inside(F.col("p"), tag)).alias(c) for c, tag in extra.items()]
    return _whole(p.select("track_id", iso_seconds(_inside(F.col("p"), "time")).alias("t"), place("lat").alias("lat"), place("lon").alias("lon"), _double(_inside(F.col("p"), "ele")).alias("alt"), *more))


def garmin(logs: DataFrame, text: str = "value", track: str = "path") -> DataFrame:
    points = F.regexp_extract_all(F.col(text), F.lit(r"(?is)(<Trackpoint\b.*?</Trackpoint>)"), F.lit(1))
    p = logs.select(F.col(track).alias("track_id"), F.explode(points).alias("p"))
    part = lambda tag: _double(_inside(F.col("p"), tag))
    return _whole(p.select("track_id", iso_seconds(_inside(F.col("p"), "Time")).alias("t"), F.coalesce(part("LatitudeDegrees"), part("Latitude")).alias("lat"), F.coalesce(part("LongitudeDegrees"), part("Longitude")).alias("lon"), F.coalesce(part("AltitudeMeters"), part("Altitude")).alias("alt")))


def kml(logs: DataFrame, text: str = "value", track: str = "path") -> DataFrame:
    """Fixes of placemarks with a time and a point, and of tracks, whose times and points stand in two lists of equal
    order."""
    doc = F.col(text)
    marks = F.regexp_extract_all(doc, F.lit(r"(?is)(<Placemark\b.*?</Placemark>)"), F.lit(1))
    p = logs.select(F.col(track).alias("track_id"), F.explode(marks).alias("p"))
    parts = F.split(_inside(F.col("p"), "coordinates"), r"[\s,]+")
    one = p.where(~F.col("p").rlike(r"(?i)<gx:coord>")).select("track_id", iso_seconds(_inside(F.col("p"), "when")).alias("t"), parts.alias("at"))
    when = F.regexp_extract_all(F.col("p"), F.lit(r"(?is)<when>\s*([^<]*?)\s*</when>"), F.lit(1))
    coords = F.regexp_extract_all(F.col("p"), F.lit(r"(?is)<gx:coord>\s*([^<]*?)\s*</gx:coord>"), F.lit(1))
    pairs = p.where(F.col("p").rlike(r"(?i)<gx:coord>")).select("track_id", F.inline(F.arrays_zip(when.alias("w"), coords.alias("c"))).alias("w", "c"))
    many = pairs.select("track_id", iso_seconds(F.col("w")).alias("t"), F.split("c", r"\s+").alias("at"))
    part = lambda k: _double(F.try_element_at("at", F.lit(k)))
    return _whole(one.unionByName(many).select("track_id", "t", part(2).alias("lat"), part(1).alias("lon"), part(3).alias("alt")))


def _angle(digits: Column, ref: Column, whole: int) -> Column:
    """ddmm.mmm with a letter, as signed degrees."""
    size = F.substring(digits, 1, whole).try_cast("double") + F.substring(digits, whole + 1, 20).try_cast("double") / 60
    return F.when(F.upper(ref).isin("S", "W"), -size).otherwise(size)


def _clock(text: Column) -> Column:
    """hhmmss[.s] as seconds of a day."""
    return F.substring(text, 1, 2).try_cast("double") * 3600 + F.substring(text, 3, 2).try_cast("double") * 60 + F.substring(text, 5, 10).try_cast("double")


def nmea(lines: DataFrame, line: str = "value", track: str = "path", order: str = "line_no") -> DataFrame:
    """Fixes of RMC, GGA, GLL, ZDA, PMGNTRK and PTNTHPR sentences (path, line_no, value). GGA and GLL have no date: they take
    that of the last sentence before them that has one, a day later each time the clock falls back by more than two seconds
    since. PTNTHPR has no time: how it was held goes to the next fix, if no other fix lies between."""
    f = F.split(F.regexp_replace(line, r"\*[0-9A-Fa-f]{2}\s*$", ""), ",")
    g = lambda k: F.try_element_at(f, F.lit(k + 1))
    kind = F.regexp_replace(F.element_at(f, 1), r"^\$(G[PN](?=RMC|GGA|GLL|ZDA)|)", "")
    rows = lines.withColumn("kind", kind)
    k = F.col("kind")
    is_ = lambda *names: k.isin(*names)
    valid = (is_("RMC") & (g(2) == "A")) | (is_("GGA") & (g(6) != "0")) | (is_("GLL") & (F.coalesce(g(6), F.lit("A")) == "A")) | is_("ZDA", "PTNTHPR") | (is_("PMGNTRK") & (g(8) == "A"))
    day = lambda text: F.unix_timestamp(F.try_to_timestamp(F.concat(F.substring(text, 1, 4), F.lit("20"), F.substring(text, 5, 2)), F.lit("ddMMyyyy")))
    first = lambda rmc, gga, gll, trk: F.when(is_("RMC"), rmc).when(is_("GGA"), gga).when(is_("GLL"), gll).when(is_("PMGNTRK"), trk)
    rows = rows.where(F.coalesce(valid, F.lit(False))).select(
        F.col(track).alias("track_id"), F.col(order).alias("line_no"), "kind",
        F.when(is_("ZDA"), _clock(g(1))).otherwise(first(_clock(g(1)), _clock(g(1)), _clock(g(5)), _clock(g(7)))).alias("clock"),
        F.when(is_("RMC"), day(g(9))).when(is_("PMGNTRK"), day(g(10))).when(is_("ZDA"), F.unix_timestamp(F.try_to_timestamp(F.concat(g(2), g(3), g(4)), F.lit("ddMMyyyy")))).alias("day"),
        first(_angle(g(3), g(4), 2), _angle(g(2), g(3), 2), _angle(g(1), g(2), 2), _angle(g(1), g(2), 2)).alias("lat"),
        first(_angle(g(5), g(6), 3), _angle(g(4), g(5), 3), _angle(g(3), g(4), 3), _angle(g(3), g(4), 3)).alias("lon"),
        F.when(is_("GGA"), _double(g(9))).when(is_("PMGNTRK"), _double(g(5))).alias("alt"),
        F.when(is_("RMC"), _double(g(7)) * KNOT).alias("speed"), F.when(is_("RMC"), _double(g(8))).alias("track"),
        F.when(is_("GGA"), _double(g(7))).alias("nsats"), F.when(is_("GGA"), _double(g(8))).alias("hdop"),
        *[F.when(is_("PTNTHPR"), _double(g(n))).alias(f"own_{c}") for c, n in (("dir", 1), ("pitch", 3), ("roll", 5))])
    w = Window.partitionBy("track_id").orderBy("line_no")
    # How it was held: from the last PTNTHPR behind the last sentence with a clock.
    held = (F.col("kind") == "PTNTHPR").cast("long")
    rows = rows.withColumn("turn", F.coalesce(F.sum(1 - held).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy("track_id", "turn").orderBy("line_no")
    rows = rows.withColumns({c: F.last(f"own_{c}", True).over(within) for c in ("dir", "pitch", "roll")}).where("kind != 'PTNTHPR'")
    rows = rows.withColumn("dated", F.last(F.when(F.col("day").isNotNull(), F.col("line_no")), True).over(w)).withColumn("base", F.last("day", True).over(w))
    rows = rows.withColumn("back", (F.lag("clock").over(w) - F.col("clock") > 2).cast("int"))
    since = Window.partitionBy("track_id", "dated").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("later", F.sum(F.when(F.col("day").isNull(), F.coalesce("back", F.lit(0))).otherwise(0)).over(since))
    rows = rows.withColumn("t", F.col("base") + F.col("clock") + 86400 * F.col("later"))
    return merged(_whole(rows.where("kind != 'ZDA'")))


def winplus(lines: DataFrame, line: str = "value", track: str = "path") -> DataFrame:
    """Fixes of lines `TP,D, latitude, longitude, month/day/year, h:m:s, n`."""
    form = r"^TP,D,\s*([-+]?\d+\.\d*),\s*([-+]?\d+\.\d*),\s*(\d+)/(\d+)/(\d{4}),\s*(\d+):(\d+):(\d+)"
    g = lambda k: F.regexp_extract(line, form, k)
    stamp = F.try_make_timestamp(g(5).try_cast("int"), g(3).try_cast("int"), g(4).try_cast("int"), g(6).try_cast("int"), g(7).try_cast("int"), g(8).try_cast("decimal(8,6)"))
    return _whole(lines.where(F.col(line).rlike(form)).select(F.col(track).alias("track_id"), stamp.cast("double").alias("t"), _double(g(1)).alias("lat"), _double(g(2)).alias("lon")))


def bramor(lines: DataFrame, line: str = "value", track: str = "path") -> DataFrame:
    """Fixes of lines of twelve fields that end in `ypr`: n, index, latitude, longitude, altitude, track, day/month/year,
    h:m:s, direction, pitch, roll."""
    f = F.split(F.trim(line), r"\s+")
    g = lambda k: F.try_element_at(f, F.lit(k + 1))
    day, clock = F.split(g(6), "/"), F.split(g(7), ":")
    part = lambda x, k: F.try_element_at(x, F.lit(k)).try_cast("int")
    seconds = F.try_element_at(clock, F.lit(3)).try_cast("double")
    stamp = F.try_make_timestamp(part(day, 3), part(day, 2), part(day, 1), part(clock, 1), part(clock, 2), F.lit(0).cast("decimal(8,6)"))
    names = {"lat": 2, "lon": 3, "alt": 4, "track": 5, "dir": 8, "pitch": 9, "roll": 10}
    fits = (F.size(f) == 12) & (g(11) == "ypr") & (F.size(day) == 3) & (F.size(clock) == 3)
    return _whole(lines.where(fits).select(F.col(track).alias("track_id"), (stamp.cast("double") + seconds).alias("t"), *[_double(g(k)).alias(c) for c, k in names.items()]))


def igc(lines: DataFrame, line: str = "value", track: str = "path", order: str = "line_no") -> DataFrame:
    """Fixes of B records under the date of the header."""
    x = F.col(line)
    day = F.unix_timestamp(F.try_to_timestamp(F.regexp_extract(x, r"^HFDTE(?:DATE:)?(\d{6})", 1), F.lit("ddMMyy")))
    w = Window.partitionBy(track).orderBy(order)
    rows = lines.withColumn("base", F.last(day, True).over(w)).where(x.rlike(r"^B\d{6}\d{7}[NS]\d{8}[EW][AV]"))
    angle = lambda at, n: (F.substring(x, at, n).try_cast("double") + F.substring(x, at + n, 5).try_cast("double") / 60000)
    lat, lon = angle(8, 2), angle(16, 3)
    return _whole(rows.select(
        F.col(track).alias("track_id"), (F.col("base") + _clock(F.substring(x, 2, 6))).alias("t"), F.when(F.substring(x, 15, 1) == "S", -lat).otherwise(lat).alias("lat"),
        F.when(F.substring(x, 24, 1) == "W", -lon).otherwise(lon).alias("lon"), F.substring(x, 31, 5).try_cast("double").alias("alt")))


def merged(*tracks: DataFrame) -> DataFrame:
    """Fixes of several logs by time: of equal times in a track each value that is given stays, the last log's first."""
    both = None
    for n, fixes in enumerate(tracks):
        fixes = fixes.select(*FIX).withColumn("log", F.lit(n))
        both = fixes if both is None else both.unionByName(fixes)
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("log"))).alias(c)
    return both.groupBy("track_id", "t").agg(*[latest(c) for c in FIX[2:]]).select(*FIX)


def with_first(fixes: DataFrame) -> DataFrame:
    """Fixes with a mark on the first of each track."""
    return fixes.withColumn("first", F.row_number().over(Window.partitionBy("track_id").orderBy("t")) == 1)
