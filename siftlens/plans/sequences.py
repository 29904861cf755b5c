"""Windows, sorting and as-of joins over the driver's tables."""

from pyspark.sql import functions as F

from siftlens.operators import asof, rows, sequence
from siftlens.plans.registry import query, read

USER = ["user_id"]


def _events(spark, d):
    return read(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")


@query("locf", """
SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_purchase FROM events""")
def locf(spark, d):
    bought = F.when(F.col("event_type") == "purchase", F.col("value"))
    return _events(spark, d).select("event_id", sequence.carried(bought, USER, "ts", "event_id").alias("last_purchase"))


@query("marker_sessions", """
SELECT event_id, CAST(coalesce(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS frame FROM events""")
def marker_sessions(spark, d):
    return _events(spark, d).select("event_id", sequence.session_number(F.col("event_type") == "signup", USER, "ts", "event_id").alias("frame"))


@query("asof_attach", """
SELECT e.event_id, s.event_id AS signup_id FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON e.user_id = s.user_id AND e.ts >= s.ts""")
def asof_attach(spark, d):
    head = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return _events(spark, d).select("event_id", sequence.carried(head, USER, "ts", "event_id").alias("signup_id"))


@query("running_with_reset", """
WITH g AS (SELECT event_id, user_id, ts, CAST(floor(value) AS BIGINT) AS v, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM events)
SELECT event_id, CAST(sum(v) OVER (PARTITION BY user_id, grp ORDER BY ts, event_id) AS BIGINT) AS running FROM g""")
def running_with_reset(spark, d):
    e = _events(spark, d).withColumn("v", F.floor("value"))
    return sequence.running_with_reset(e, "v", F.col("event_type") == "signup", USER, "ts", "event_id").select("event_id", "running")


@query("lag_gap", """
SELECT event_id, coalesce(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 1800, true) AS starts FROM events""")
def lag_gap(spark, d):
    e = _events(spark, d).withColumn("t", F.col("ts").cast("timestamp").cast("double"))
    gap = F.col("t") - sequence.previous("t", USER, "ts", "event_id")
    return e.select("event_id", F.coalesce(gap > 1800, F.lit(True)).alias("starts"))


_LINE = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")


@query("partition_prefix_sum", f"""
SELECT l_orderkey, {", ".join(_LINE)}, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_LINE)} ROWS UNBOUNDED PRECEDING) AS running FROM lineitem""")
def partition_prefix_sum(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", *_LINE, sequence.running("l_quantity", ["l_orderkey"], *_LINE).alias("running"))


@query("rollover_fix", """
WITH t AS (SELECT event_id, user_id, ts, CAST(floor(epoch(ts)) AS BIGINT) % 86400 AS tod FROM events),
f AS (SELECT *, CASE WHEN lag(tod) OVER (PARTITION BY user_id ORDER BY ts, event_id) - tod > 2 THEN 1 ELSE 0 END AS flag FROM t)
SELECT event_id, CAST(tod + 86400 * sum(flag) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS elapsed FROM f""")
def rollover_fix(spark, d):
    e = _events(spark, d).withColumn("tod", F.unix_timestamp(F.col("ts").cast("timestamp")) % 86400)
    flag, _ = sequence.rolled_days("tod", USER, "ts", "event_id")
    e = e.withColumn("flag", flag)
    return e.select("event_id", (F.col("tod") + 86400 * sequence.running("flag", USER, "ts", "event_id")).alias("elapsed"))


@query("first_fix_flag", """
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS first, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS seq FROM events""")
def first_fix_flag(spark, d):
    place = F.row_number().over(sequence.along(USER, "ts", "event_id"))
    return _events(spark, d).select("event_id", (place == 1).alias("first"), place.alias("seq"))


_MIXED = """
SELECT p_partkey, key, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN key IS NULL THEN 2 WHEN num IS NOT NULL THEN 0 ELSE 1 END, num NULLS LAST,
  CASE WHEN num IS NULL THEN regexp_replace(regexp_replace(lower(key), '([0-9]+)', '000000000000\\1', 'g'), '0+([0-9]{12})([^0-9]|$)', '\\1\\2', 'g') END NULLS LAST, p_partkey) AS BIGINT) AS place
FROM (SELECT p_partkey, p_brand, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN p_brand WHEN 2 THEN p_type END AS key, CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS DOUBLE) END AS num FROM part)"""


@query("file_order_mixed", _MIXED)
def file_order_mixed(spark, d):
    key = F.when(F.col("p_partkey") % 4 == 0, F.col("p_size").cast("string")).when(F.col("p_partkey") % 4 == 1, F.col("p_brand")).when(F.col("p_partkey") % 4 == 2, F.col("p_type"))
    p = read(spark, d, "part").select("p_partkey", "p_brand", key.alias("key"))
    order = sequence.along(["p_brand"], *rows.mixed_order(F.col("key")), F.col("p_partkey").asc())
    return p.select("p_partkey", "key", F.row_number().over(order).cast("long").alias("place"))


@query("list_item", "SELECT doc_id, string_split(text, ' ')[3] AS third, string_split(text, ' ')[-1] AS last FROM documents")
def list_item(spark, d):
    words = F.split("text", " ")
    return read(spark, d, "documents").select("doc_id", rows.list_item(words, 2).alias("third"), rows.list_item(words, -1).alias("last"))


@query("snip", "SELECT doc_id, CASE WHEN length(text) > 60 THEN left(text, 54) || '[snip]' ELSE text END AS shown FROM documents")
def snip(spark, d):
    return read(spark, d, "documents").select("doc_id", rows.snip(F.col("text")).alias("shown"))


# Fixes are the purchases of a user, probes all other events; times in seconds.
_TRACK = """
WITH t AS (SELECT event_id, user_id, epoch(ts) AS t, event_type, value, {value} AS v FROM events), f AS (SELECT * FROM t WHERE event_type = 'purchase'),
b AS (SELECT p.event_id, p.user_id, p.t, f.t AS t0, f.v AS v0 FROM (SELECT * FROM t WHERE event_type <> 'purchase') p ASOF LEFT JOIN f ON p.user_id = f.user_id AND p.t >= f.t),
q AS (SELECT b.*, f.t AS t1, f.v AS v1 FROM b ASOF LEFT JOIN f ON b.user_id = f.user_id AND b.t < f.t)
"""
_NEAR = "CASE WHEN t0 IS NULL THEN 1 WHEN t1 IS NULL THEN 0 WHEN t - t0 < t1 - t THEN 0 ELSE 1 END"


def _geo(spark, d, value):
    e = _events(spark, d).withColumn("t", F.col("ts").cast("timestamp").cast("double")).withColumn("v", value)
    probes = e.where("event_type <> 'purchase'").select("user_id", "t", "event_id")
    return probes, e.where("event_type = 'purchase'").select("user_id", "t", "v")


@query("geo_interpolate", _TRACK.format(value="value") + f"""
SELECT event_id, CASE WHEN t0 IS NOT NULL AND t1 IS NOT NULL AND t1 - t0 <= 36000 THEN v0 + (v1 - v0) * ((t - t0) / (t1 - t0))
  WHEN {_NEAR} = 0 THEN CASE WHEN t - t0 <= 1800 THEN v0 END WHEN t1 - t <= 1800 THEN v1 END AS v FROM q""")
def geo_interpolate(spark, d):
    probes, fixes = _geo(spark, d, F.col("value"))
    return asof.interpolate(probes, fixes, USER, "t", ["v"], ["event_id"], within=36000.0).select("event_id", "v")


@query("geo_circular", _TRACK.format(value="fmod(value * 7, 360)") + f"""
, c AS (SELECT *, v0 + CASE WHEN v1 - v0 > 180 THEN 360 ELSE 0 END AS a, v1 + CASE WHEN v0 - v1 > 180 THEN 360 ELSE 0 END AS z FROM q),
r AS (SELECT *, a + (z - a) * ((t - t0) / (t1 - t0)) AS m FROM c)
SELECT event_id, CASE WHEN t0 IS NOT NULL AND t1 IS NOT NULL AND t1 - t0 <= 36000 THEN CASE WHEN m >= 360 THEN m - 360 ELSE m END
  WHEN {_NEAR} = 0 THEN CASE WHEN t - t0 <= 1800 THEN v0 END WHEN t1 - t <= 1800 THEN v1 END AS v FROM r""")
def geo_circular(spark, d):
    probes, fixes = _geo(spark, d, (F.col("value") * 7) % 360)
    return asof.interpolate(probes, fixes, USER, "t", ["v"], ["event_id"], circular={"v": 360.0}, within=36000.0).select("event_id", "v")


@query("nearest_non_null", """
WITH e AS (SELECT event_id, user_id, epoch(ts) AS t, CASE WHEN event_type = 'purchase' THEN value END AS v FROM events), f AS (SELECT * FROM e WHERE v IS NOT NULL),
a AS (SELECT e.event_id, e.user_id, e.t, f.t AS t0, f.v AS v0 FROM e ASOF LEFT JOIN f ON e.user_id = f.user_id AND e.t >= f.t),
b AS (SELECT a.*, f.t AS t1, f.v AS v1 FROM a ASOF LEFT JOIN f ON a.user_id = f.user_id AND a.t <= f.t)
SELECT event_id, CASE WHEN t0 IS NOT NULL AND (t1 IS NULL OR t - t0 <= t1 - t) THEN CASE WHEN t - t0 <= 7200 THEN v0 END WHEN t1 - t <= 7200 THEN v1 END AS near FROM b""")
def nearest_non_null(spark, d):
    e = _events(spark, d).select("event_id", "user_id", F.col("ts").cast("timestamp").cast("double").alias("t"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("v"))
    return e.select("event_id", asof.nearest(e, "v", USER, "t", "event_id", within=7200.0).alias("near"))


@query("drift_correction", """
WITH e AS (SELECT event_id, epoch(ts) AS t FROM events)
SELECT event_id, t - CASE WHEN t < 1705000000 THEN 10.0 + (t - 1704067200) * ((20.0 - 10.0) / (1705000000.0 - 1704067200.0)) ELSE 20.0 + (t - 1705000000) * ((-5.0 - 20.0) / (1706000000.0 - 1705000000.0)) END AS corrected FROM e""")
def drift_correction(spark, d):
    e = _events(spark, d).select("event_id", F.col("ts").cast("timestamp").cast("double").alias("t"))
    return e.select("event_id", asof.drift_corrected(e, [(1704067200.0, 10.0), (1705000000.0, 20.0), (1706000000.0, -5.0)], "t").alias("corrected"))
