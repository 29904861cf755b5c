"""Track logs made from the driver's tables, read back as fixes."""

from pyspark.sql import functions as F

from siftlens.plans.registry import query, read
from siftlens.sources import tracks


@query("track_logs", """
SELECT CAST(c_nationkey AS VARCHAR) AS track_id, CAST(1000000000 + c_custkey * 7 AS DOUBLE) AS t, 43 + (CAST(c_custkey % 60 AS DOUBLE) + 0.5) / 60 AS lat, -(5 + (CAST(c_custkey % 50 AS DOUBLE) + 0.25) / 60) AS lon,
  CAST(c_custkey % 300 AS DOUBLE) AS dir, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = 1 AS first FROM customer""")
def track_logs(spark, d):
    k = F.col("c_custkey")
    stamp = F.timestamp_seconds(k * 7 + 1_000_000_000)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    held = F.concat(F.lit("$PTNTHPR,"), (k % 300).cast("string"), F.lit(".0,N,-1.5,N,2.5,N,A*00"))
    rmc = F.concat(F.lit("$GPRMC,"), F.date_format(stamp, "HHmmss"), F.lit(".000,A,43"), two(k % 60), F.lit(".5000,N,005"), two(k % 50), F.lit(".2500,W,10.0,,"), F.date_format(stamp, "ddMMyy"), F.lit(",,,A*00"))
    lines = read(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("path"), F.posexplode(F.array(held, rmc)).alias("n", "value"), (k * 2).alias("at"))
    fixes = tracks.nmea(lines.withColumn("line_no", F.col("at") + F.col("n")))
    return tracks.with_first(fixes).select("track_id", "t", "lat", "lon", "dir", "first")


@query("track_columns", """
SELECT 'log' AS track_id, CAST(epoch(TIMESTAMP '2015-04-22 00:00:00') + p_partkey % 86400 AS DOUBLE) AS t, CAST(p_partkey % 80 AS DOUBLE) + 0.125 AS lat, CAST(p_partkey % 170 AS DOUBLE) + 0.5 AS lon, CAST(p_size AS DOUBLE) AS alt,
  CAST(p_partkey % 360 AS DOUBLE) AS track, CAST(p_size AS DOUBLE) AS dir, CAST(-p_size AS DOUBLE) AS pitch, 0.25 AS roll FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part)""".replace("0.25 AS roll", "CAST(0.25 AS DOUBLE) AS roll"))
def track_columns(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    text = lambda x: x.cast("string")
    clock = F.date_format(F.timestamp_seconds(k % 86400), "HH:mm:ss")
    line = F.concat_ws("  ", F.lit(" 1"), text(k), F.concat(text(k % 80), F.lit(".125")), F.concat(text(k % 170), F.lit(".5")), s, text(k % 360), F.lit("22/04/2015"), clock, s, F.concat(F.lit("-"), s), F.lit("0.25 ypr"))
    lines = read(spark, d, "part").select(F.lit("log").alias("path"), line.alias("value"))
    return tracks.bramor(lines).select("track_id", "t", "lat", "lon", "alt", "track", "dir", "pitch", "roll")
