"""Dates over the driver's tables: shifting with carries, showing, parsing, zones."""

from pyspark.sql import functions as F

from siftlens.functions import datetime as dt
from siftlens.plans.registry import query, read


def _orders(spark, d):
    o = read(spark, d, "orders")
    return o.select("o_orderkey", "o_custkey", F.date_format("o_orderdate", dt.TEXT).alias("text"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("t"))


_MOVED = "CAST(make_date(CAST(({m}) // 12 AS BIGINT), CAST(({m}) % 12 + 1 AS BIGINT), 1) AS TIMESTAMP) + to_days(CAST(day(o_orderdate) - 1 + {days} AS INTEGER)) + to_seconds({seconds})"
_MONTH = "(year(o_orderdate) + {y}) * 12 + month(o_orderdate) - 1 + {m}"


@query("shift_time_full", f"""
SELECT o_orderkey, strftime({_MOVED.format(m=_MONTH.format(y=1, m=14), days=40, seconds=30 * 3600 + 75 * 60 + 90)}, '%Y:%m:%d %H:%M:%S') AS ahead,
  strftime({_MOVED.format(m=_MONTH.format(y=0, m=-1), days=-3, seconds=-(5 * 3600 + 1))}, '%Y:%m:%d %H:%M:%S') AS back,
  strftime(o_orderdate - to_seconds(1), '%Y:%m:%d %H:%M:%S') || '.75' AS fraction FROM orders""")
def shift_time_full(spark, d):
    o, text = _orders(spark, d), F.col("text")
    return o.select(
        "o_orderkey", dt.shifted_text(text, "1:14:40 30:75:90").alias("ahead"), dt.shifted_text(text, "0:1:3 5:0:1", back=True).alias("back"),
        dt.shifted_text(F.concat(text, F.lit(".25")), "0:0:0.5", back=True).alias("fraction"))


@query("global_shift", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate + to_seconds(5400), '%Y:%m:%d %H:%M:%S') AS shipped, strftime(l_shipdate + to_seconds(5400 + 86400), '%Y:%m:%d %H:%M:%S') AS due FROM lineitem""")
def global_shift(spark, d):
    li = read(spark, d, "lineitem")
    rows = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", dt.TEXT).alias("shipped"), F.date_format(F.col("l_shipdate") + F.expr("interval 1 day"), dt.TEXT).alias("due"))
    return dt.all_shifted(rows, ["shipped", "due"], "1:30:00")


@query("strftime", """
SELECT o_orderkey, strftime(o_orderdate, '%a %d %b %Y, %H:%M:%S %p (%j) %y') AS long_, strftime(o_orderdate, '%A, %B 100%%') || ' ' || CAST(CAST(epoch(o_orderdate) AS BIGINT) AS VARCHAR) || ' +0000' AS words FROM orders""")
def strftime(spark, d):
    t = F.col("t")
    return _orders(spark, d).select("o_orderkey", dt.strftime(t, "%a %d %b %Y, %H:%M:%S %p (%j) %y").alias("long_"), dt.strftime(t, "%A, %B 100%% %s %z").alias("words"))


@query("local_time", """
SELECT o_orderkey, strftime(o_orderdate + to_minutes(m), '%Y:%m:%d %H:%M:%S') || zone AS shown FROM (
  SELECT *, CASE WHEN m < 0 THEN '-' ELSE '+' END || lpad(CAST(abs(m) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(abs(m) % 60 AS VARCHAR), 2, '0') AS zone
  FROM (SELECT o_orderkey, o_orderdate, CAST(o_custkey % 29 * 45 - 600 AS BIGINT) AS m FROM orders))""")
def local_time(spark, d):
    return _orders(spark, d).select("o_orderkey", dt.local_text(F.col("t"), F.col("o_custkey") % 29 * 45 - 600).alias("shown"))


@query("loose_dates", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL WHEN o_orderkey % 5 = 2 THEN CAST(epoch(CAST(o_orderdate AS DATE)) AS BIGINT) WHEN o_orderkey % 5 = 3 THEN CAST(epoch(date_trunc('minute', o_orderdate)) AS BIGINT)
  ELSE CAST(epoch(o_orderdate) AS BIGINT) END AS seconds FROM orders""")
def loose_dates(spark, d):
    by, form = F.col("o_orderkey") % 5, lambda f: F.date_format("o_orderdate", f)
    text = F.when(by == 0, form("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(by == 1, form("yyyyMMddHHmmss")).when(by == 2, form("yyyy/MM/dd")).when(by == 3, form("yyyy:MM:dd HH:mm")).otherwise("soon")
    return read(spark, d, "orders").select("o_orderkey", dt.loose_seconds(text).alias("seconds"))


@query("gps_clock", """
SELECT c_custkey, printf('%02d:%02d:%02d', t // 3600, t // 60 % 60, t % 60) AS shown
FROM (SELECT c_custkey, CAST((c_custkey % 24) * 3600 + (c_custkey % 59) * 60 + 30 + (c_custkey % 61) AS BIGINT) AS t FROM customer)""")
def gps_clock(spark, d):
    k = F.col("c_custkey")
    return read(spark, d, "customer").select("c_custkey", dt.gps_clock(k % 24, k % 59 + 0.5, (k % 61).cast("double") + 0.25).alias("shown"))
