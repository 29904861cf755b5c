"""Derived columns of metadata over the driver's tables."""

from pyspark.sql import functions as F

from siftlens.operators.composites import with_composites
from siftlens.plans.registry import query, read


@query("composite_columns", """
SELECT p_partkey, CAST(w AS VARCHAR) || 'x4000' AS ImageSize, CAST(w AS DOUBLE) * 4000 / 1000000 AS Megapixels, 1 / CAST(w AS DOUBLE) AS ShutterSpeed, CASE WHEN w % 2 = 0 THEN CAST(w AS DOUBLE) ELSE 2.5 END AS Aperture,
  round(log2(a * a * 100 * w / 200), 9) AS LightValue, 1.5 AS ScaleFactor35efl, f * 1.5 AS FocalLength35efl, round(f * f / (a * (sqrt(1872.0) / (1.5 * 1440)) * 1000), 9) AS HyperfocalDistance,
  printf('%03d-%04d', w, p_partkey % 10000) AS FileNumber, '2020:01:02 03:04:05.' || CAST(w AS VARCHAR) AS SubSecCreateDate, CAST(p_partkey AS DOUBLE) / w AS Duration, -f AS GPSLatitude
FROM (SELECT p_partkey, w, CAST(w + 10 AS DOUBLE) AS f, CASE WHEN w % 2 = 0 THEN CAST(w AS DOUBLE) ELSE 2.5 END AS a FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS w FROM part))""".replace("2.5 END", "CAST(2.5 AS DOUBLE) END").replace("1.5 AS Scale", "CAST(1.5 AS DOUBLE) AS Scale").replace("sqrt(1872.0)", "sqrt(CAST(1872 AS DOUBLE))"))
def composite_columns(spark, d):
    w = F.col("p_size")
    f = (w + 10).cast("double")
    p = read(spark, d, "part").select(
        "p_partkey", w.alias("ImageWidth"), F.lit(4000).alias("ImageHeight"), (1 / w.cast("double")).alias("ExposureTime"), F.when(w % 2 == 0, w.cast("double")).alias("FNumber"), F.lit(2.5).alias("ApertureValue"),
        F.lit(200).alias("ISO"), f.alias("FocalLength"), (f * 1.5).alias("FocalLengthIn35mmFormat"), w.alias("DirectoryIndex"), (F.col("p_partkey") % 10000).alias("FileIndex"),
        F.lit("2020:01:02 03:04:05").alias("CreateDate"), w.cast("string").alias("SubSecTimeDigitized"), w.alias("SampleRate"), F.col("p_partkey").alias("TotalSamples"), f.alias("GPSLatitudeValue"), F.lit("South").alias("GPSLatitudeRef"))
    made = with_composites(p)
    return made.select(
        "p_partkey", "ImageSize", "Megapixels", "ShutterSpeed", "Aperture", F.round("LightValue", 9).alias("LightValue"), "ScaleFactor35efl", "FocalLength35efl", F.round("HyperfocalDistance", 9).alias("HyperfocalDistance"),
        "FileNumber", "SubSecCreateDate", "Duration", "GPSLatitude")
