"""What leaves the engine: CSV over the union of names, text layouts, file names, nested JSON, position columns."""

from pyspark.sql import functions as F

from siftlens.operators import asof
from siftlens.plans.registry import query, read
from siftlens.sinks import text as sinks

_KINDS = ["click", "error", "purchase", "signup", "view"]


@query("csv_union", "SELECT user_id, CAST(user_id AS VARCHAR) || ',' || " + " || ',' || ".join(f"coalesce(CAST(nullif(count(*) FILTER (WHERE event_type = '{t}' AND event_id % 3 = 0), 0) AS VARCHAR), '')" for t in _KINDS) + """ AS line
FROM events WHERE event_id % 3 = 0 GROUP BY user_id""")
def csv_union(spark, d):
    e = read(spark, d, "events").where("event_id % 3 = 0").groupBy("user_id", "event_type").agg(F.count("*").cast("string").alias("n"))
    return sinks.csv_export(e, "user_id", "event_type", "n")[1]


@query("text_layouts", """
SELECT p_partkey, n || ': ' || v AS plain, '[' || p_brand || '] ' || rpad(n, 32, ' ') || ': ' || v AS grouped, p_type || ': ' || v AS short, p_type || ' ' || v AS very_short, rpad(n, 32, ' ') || ': ' || v AS long_,
  n || chr(9) || v AS tab, '<tr><td>' || n || '</td><td>' || v || '</td></tr>' AS table_, '-' || p_brand || ':' || p_type || '=' || v AS args, v AS values_ FROM (SELECT *, p_name AS n, CAST(p_size AS VARCHAR) AS v FROM part)""")
def text_layouts(spark, d):
    own = {"plain": "plain", "group": "grouped", "short": "short", "very_short": "very_short", "long": "long_", "tab": "tab", "table": "table_", "args": "args", "values": "values_"}
    line = lambda layout: sinks.laid_out(layout, F.col("p_brand"), F.col("p_type"), F.col("p_name"), F.col("p_size").cast("string"))
    return read(spark, d, "part").select("p_partkey", *[line(k).alias(v) for k, v in own.items()])


@query("output_names", r"""
SELECT page_id, d || 'out/' || left(f, 3) || '_' || right(upper(f), 2) || '.txt%' AS name FROM (SELECT page_id, regexp_extract(url, '^(.*/)', 1) AS d, regexp_extract(url, '([^/]*?)(?:\.[^./]*)?$', 1) AS f FROM pages)""")
def output_names(spark, d):
    return read(spark, d, "pages").select("page_id", sinks.output_name("%dout/%3f_%-2Uf.txt%%", F.col("url")).alias("name"))


@query("unique_names", """
SELECT doc_id, source || CASE WHEN n > 0 THEN '_' || CAST(n AS VARCHAR) ELSE '' END || '.txt' AS target FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source, doc_id % 100 ORDER BY doc_id) - 1 AS n FROM documents WHERE doc_id % 100 = 0)
UNION ALL SELECT doc_id, CAST(doc_id AS VARCHAR) || '.txt' FROM documents WHERE doc_id % 100 <> 0""")
def unique_names(spark, d):
    name = F.when(F.col("doc_id") % 100 == 0, F.concat("source", F.lit(".txt"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return sinks.counted_names(read(spark, d, "documents").select("doc_id", name.alias("name")), "name", "doc_id").select("doc_id", "target")


@query("nested_json", """
SELECT p_partkey, '{"size":' || CAST(p_size AS VARCHAR) || ',"names":["' || p_brand || '","' || p_type || '"],"at":{"x":' || CAST(p_size AS VARCHAR) || '},"data":"base64:' || to_base64(encode(p_brand)) || '"}' AS record FROM part""")
def nested_json(spark, d):
    s = F.col("p_size")
    record = sinks.json_nested({"size": s, "none": F.lit(None).cast("string"), "names": F.array("p_brand", "p_type"), "at": F.struct(s.alias("x")), "data": sinks.base64_text(F.col("p_brand").cast("binary"))})
    return read(spark, d, "part").select("p_partkey", record.alias("record"))


@query("position_columns", """
SELECT c_custkey, abs(lat) AS GPSLatitude, CASE WHEN lat < 0 THEN 'S' ELSE 'N' END AS GPSLatitudeRef, abs(lon) AS GPSLongitude, CASE WHEN lon < 0 THEN 'W' ELSE 'E' END AS GPSLongitudeRef,
  abs(alt) AS GPSAltitude, CASE WHEN alt < 0 THEN 1 ELSE 0 END AS GPSAltitudeRef, strftime(make_timestamp(c_custkey * 86461 * 1000000), '%Y:%m:%d') AS GPSDateStamp, strftime(make_timestamp(c_custkey * 86461 * 1000000), '%H:%M:%S') AS GPSTimeStamp,
  track AS GPSTrack, CASE WHEN track IS NOT NULL THEN 'T' END AS GPSTrackRef, speed AS GPSSpeed, CASE WHEN speed IS NOT NULL THEN 'K' END AS GPSSpeedRef
FROM (SELECT c_custkey, CAST(c_nationkey - 12 AS DOUBLE) AS lat, CAST(c_custkey % 360 - 180 AS DOUBLE) AS lon, CAST(c_acctbal AS DOUBLE) AS alt, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey % 360 AS DOUBLE) END AS track, CASE WHEN c_custkey % 2 > 0 THEN CAST(c_custkey % 90 AS DOUBLE) END AS speed FROM customer)""")
def position_columns(spark, d):
    k = F.col("c_custkey")
    fixes = read(spark, d, "customer").select(
        "c_custkey", (k * 86461).alias("t"), (F.col("c_nationkey") - 12).cast("double").alias("lat"), (k % 360 - 180).cast("double").alias("lon"), F.col("c_acctbal").cast("double").alias("alt"),
        F.when(k % 3 > 0, (k % 360).cast("double")).alias("track"), F.when(k % 2 > 0, (k % 90).cast("double")).alias("speed"))
    return asof.position_columns(fixes, ["c_custkey"])
