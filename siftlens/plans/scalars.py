"""Scalar functions over the driver's tables."""

from pyspark.sql import functions as F

from siftlens.functions import binary as bn
from siftlens.functions import datetime as dt
from siftlens.functions import numeric as nm
from siftlens.functions import text as tx
from siftlens.plans.registry import query, read


@query("fmt_file_size", """
SELECT doc_id, CASE WHEN n < 2048 THEN CAST(n AS VARCHAR) || ' bytes' WHEN n < 10240 THEN printf('%.1f', round(n / 1024.0, 1)) || ' kB'
  WHEN n < 2097152 THEN CAST(CAST(round(n / 1024.0) AS BIGINT) AS VARCHAR) || ' kB' WHEN n < 10485760 THEN printf('%.1f', round(n / 1048576.0, 1)) || ' MB'
  ELSE CAST(CAST(round(n / 1048576.0) AS BIGINT) AS VARCHAR) || ' MB' END AS size FROM (SELECT doc_id, n_chars * 37 + 1 AS n FROM documents)""")
def fmt_file_size(spark, d):
    return read(spark, d, "documents").select("doc_id", nm.file_size(F.col("n_chars") * 37 + 1).alias("size"))


@query("fmt_duration", """
WITH s AS (SELECT event_id, CAST(floor(value) AS BIGINT) * 997 AS t FROM events), h AS (SELECT *, t // 3600 AS hours FROM s)
SELECT event_id, CASE WHEN t = 0 THEN '0 s' WHEN t < 30 THEN printf('%.2f', t) || ' s'
  WHEN hours > 24 THEN CAST(t // 86400 AS VARCHAR) || ' days ' || CAST(hours - (t // 86400) * 24 AS VARCHAR) || printf(':%02d:%02d', t // 60 % 60, t % 60)
  ELSE CAST(hours AS VARCHAR) || printf(':%02d:%02d', t // 60 % 60, t % 60) END AS shown FROM h""")
def fmt_duration(spark, d):
    return read(spark, d, "events").select("event_id", nm.duration(F.floor("value") * 997).alias("shown"))


@query("fmt_bitrate", """
SELECT p_partkey, CASE WHEN v < 100 THEN printf('%.1f', v) ELSE CAST(CAST(round(v) AS BIGINT) AS VARCHAR) END || ' ' || unit AS rate
FROM (SELECT p_partkey, CASE WHEN r < 1000 THEN r WHEN r < 1000000 THEN r / 1000.0 WHEN r < 1000000000 THEN r / 1000000.0 ELSE r / 1000000000.0 END AS v,
  CASE WHEN r < 1000 THEN 'bps' WHEN r < 1000000 THEN 'kbps' WHEN r < 1000000000 THEN 'Mbps' ELSE 'Gbps' END AS unit
  FROM (SELECT p_partkey, CAST(p_size * p_size * p_size AS DOUBLE) * 1000 + 0.25 AS r FROM part))""")
def fmt_bitrate(spark, d):
    return read(spark, d, "part").select("p_partkey", nm.bit_rate((F.col("p_size") * F.col("p_size") * F.col("p_size")).cast("double") * 1000 + 0.25).alias("rate"))


@query("fmt_time_span", """
SELECT doc_id, CASE WHEN t >= 86400 THEN printf('%.1f', t / 86400) || ' days' WHEN t >= 3600 THEN printf('%.1f', t / 3600) || ' hours'
  WHEN t >= 60 THEN printf('%.1f', t / 60) || ' minutes' ELSE CAST(n AS VARCHAR) || ' seconds' END AS span
FROM (SELECT doc_id, n, CASE WHEN n >= 60 THEN n + 0.013 ELSE n END AS t FROM (SELECT doc_id, n_chars * 7 AS n FROM documents))""")
def fmt_time_span(spark, d):
    n = F.col("n_chars") * 7
    docs = read(spark, d, "documents").select("doc_id", n.alias("n"))
    long_ = nm.time_span(F.col("n") + 0.013)
    return docs.select("doc_id", F.when(F.col("n") >= 60, long_).otherwise(nm.time_span(F.col("n"))).alias("span"))


@query("fmt_exposure", """
SELECT p_partkey, CASE WHEN s < 0.25001 THEN '1/' || CAST(CAST(floor(0.5 + 1 / s) AS BIGINT) AS VARCHAR) ELSE regexp_replace(printf('%.1f', s), '\\.0$', '') END AS shown
FROM (SELECT p_partkey, p_size / 97.0 + 0.001 AS s FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size FROM part))""".replace("\\\\", "\\"))
def fmt_exposure(spark, d):
    return read(spark, d, "part").select("p_partkey", nm.exposure_time(F.col("p_size") / 97.0 + 0.001).alias("shown"))


@query("fmt_fraction", """
SELECT vec_id, k, CASE k WHEN -6 THEN '-1' WHEN -5 THEN '-0.833' WHEN -4 THEN '-2/3' WHEN -3 THEN '-1/2' WHEN -2 THEN '-1/3' WHEN -1 THEN '-0.167' WHEN 0 THEN '0'
  WHEN 1 THEN '+0.167' WHEN 2 THEN '+1/3' WHEN 3 THEN '+1/2' WHEN 4 THEN '+2/3' WHEN 5 THEN '+0.833' ELSE '+1' END AS shown
FROM (SELECT vec_id, CAST(vec_id % 13 - 6 AS BIGINT) AS k FROM embeddings)""")
def fmt_fraction(spark, d):
    k = F.col("vec_id") % 13 - 6
    return read(spark, d, "embeddings").select("vec_id", k.alias("k"), nm.fraction(k / 6.0).alias("shown"))


_ANGLE = "(c_acctbal * 0.01)"


@query("gps_dms", f"""
WITH t AS (SELECT c_custkey, round(abs({_ANGLE}) * 3600, 2) AS total FROM customer), u AS (SELECT *, CAST(floor(total / 3600) AS BIGINT) AS d FROM t),
v AS (SELECT *, CAST(floor((total - d * 3600) / 60) AS BIGINT) AS m FROM u)
SELECT c_custkey, d, m, round(total - d * 3600 - m * 60, 2) AS s FROM v""")
def gps_dms(spark, d):
    return read(spark, d, "customer").select("c_custkey", nm.dms(F.col("c_acctbal") * 0.01).alias("x")).select("c_custkey", "x.d", "x.m", "x.s")


@query("to_degrees", """
SELECT c_custkey, CASE WHEN c_nationkey % 2 = 1 THEN -1 ELSE 1 END * (c_nationkey + (c_custkey % 60) / 60.0 + (c_custkey % 7) / 3600.0) AS degrees
FROM (SELECT c_custkey, CAST(c_custkey AS DOUBLE) AS k, c_nationkey FROM customer)""")
def to_degrees(spark, d):
    ref = F.when(F.col("c_nationkey") % 2 == 1, "South").otherwise("N")
    return read(spark, d, "customer").select("c_custkey", nm.from_dms(F.col("c_nationkey"), F.col("c_custkey") % 60, F.col("c_custkey") % 7, ref).alias("degrees"))


@query("unix_time", "SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS seconds, strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') AS shown FROM orders")
def unix_time(spark, d):
    o = read(spark, d, "orders").withColumn("shown", F.date_format("o_orderdate", dt.TEXT))
    return o.select("o_orderkey", dt.seconds_of(F.col("shown")).alias("seconds"), dt.text_of(dt.seconds_of(F.col("shown"))).alias("shown"))


@query("exif_date", """
SELECT o_orderkey, strftime(o_orderdate, '%Y:%m:%d') AS day, CAST(epoch(o_orderdate) AS BIGINT) - 5400 AS east, CAST(NULL AS BIGINT) AS none FROM orders""")
def exif_date(spark, d):
    text = F.date_format("o_orderdate", dt.TEXT)
    return read(spark, d, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy:MM:dd").alias("day"), dt.seconds_of(F.concat(text, F.lit("+01:30"))).alias("east"), dt.seconds_of(F.lit("not a date")).alias("none"))


@query("shift_time", """
SELECT o_orderkey, make_date(CAST((y * 12 + m) // 12 AS BIGINT), CAST((y * 12 + m) % 12 + 1 AS BIGINT), 1) + CAST(d - 1 AS INTEGER) AS shifted
FROM (SELECT o_orderkey, year(o_orderdate) + 1 AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders)""")
def shift_time(spark, d):
    day = F.col("o_orderdate")
    return read(spark, d, "orders").select("o_orderkey", dt.shifted(F.year(day), F.month(day), F.day(day), years=1, months=1).alias("shifted"))


@query("text_escape", """
SELECT page_id, length(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS n,
  md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS digest, true AS back FROM pages""")
def text_escape(spark, d):
    e = tx.html_escaped(F.col("html"))
    return read(spark, d, "pages").select("page_id", F.length(e).cast("long").alias("n"), F.md5(e.cast("binary")).alias("digest"), (tx.xml_unescaped(tx.xml_escaped(F.col("html"))) == F.col("html")).alias("back"))


@query("url_parts", r"""
SELECT page_id, regexp_extract(url, '^(.*/)', 1) AS directory, regexp_extract(url, '([^/]*?)(?:\.[^./]*)?$', 1) AS name, regexp_extract(url, '\.([^./]*)$', 1) AS extension FROM pages""")
def url_parts(spark, d):
    p = tx.path_parts(F.col("url"))
    return read(spark, d, "pages").select("page_id", *[c.alias(n) for n, c in p.items()])


@query("case_pad", """
SELECT p_partkey, upper(p_brand) AS up, lower(p_type) AS low, CASE WHEN p_size - 25 < 0 THEN '-' ELSE '' END || lpad(CAST(abs(p_size - 25) AS VARCHAR), 6, '0') AS padded FROM part""")
def case_pad(spark, d):
    return read(spark, d, "part").select("p_partkey", F.upper("p_brand").alias("up"), F.lower("p_type").alias("low"), tx.zero_padded(F.col("p_size") - 25, 6).alias("padded"))


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.absent') IS NULL AS absent FROM events")
def json_props(spark, d):
    v = F.try_parse_json("props")
    return read(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.absent", "string").isNull().alias("absent"))


@query("charset_valid", r"SELECT doc_id, true AS valid, NOT regexp_matches(text, '[\x{80}-\x{FF}]') AS latin_valid FROM documents")
def charset_valid(spark, d):
    """Texts as UTF-8 and as Latin-1 bytes: which are valid UTF-8."""
    latin = F.encode(F.regexp_replace("text", r"[^\x00-\xFF]", "?"), "ISO-8859-1")
    return read(spark, d, "documents").select("doc_id", tx.is_utf8(F.col("text")).alias("valid"), tx.is_utf8(latin).alias("latin_valid"))


@query("number_kinds", r"""
SELECT p_partkey, regexp_matches(k, '^[+-]?(\d|\.\d)\d*(\.\d*)?([Ee][+-]?\d+)?$') AS is_float, regexp_matches(k, '^[+-]?\d+$') AS is_int, regexp_matches(k, '^(0x)?[0-9a-fA-F]+$') AS is_hex,
  regexp_matches(k, '^[-+]?\d+/\d+$') AS is_rational, try_cast(nullif(regexp_extract(k, '([+-]?(?:\d+\.?\d*|\.\d+)(?:[Ee][+-]?\d+)?)', 1), '') AS DOUBLE) AS number
FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN p_brand WHEN 2 THEN CAST(p_size AS VARCHAR) || '/7' WHEN 3 THEN '-' || CAST(p_size AS VARCHAR) || '.5' ELSE 'beef' END AS k FROM part)""")
def number_kinds(spark, d):
    size = F.col("p_size").cast("string")
    by = F.col("p_partkey") % 5
    k = F.when(by == 0, size).when(by == 1, F.col("p_brand")).when(by == 2, F.concat(size, F.lit("/7"))).when(by == 3, F.concat(F.lit("-"), size, F.lit(".5"))).otherwise("beef")
    p = read(spark, d, "part").select("p_partkey", k.alias("k"))
    k = F.col("k")
    return p.select("p_partkey", tx.is_float(k).alias("is_float"), tx.is_int(k).alias("is_int"), tx.is_hex(k).alias("is_hex"), tx.is_rational(k).alias("is_rational"), tx.first_number(k).alias("number"))


@query("csv_fields", """
SELECT doc_id, md5(CASE WHEN regexp_matches(text, '[,"\\r\\n]|^\\s|\\s$') THEN '"' || replace(text, '"', '""') || '"' ELSE text END) AS field FROM documents""".replace("\\\\", "\\"))
def csv_fields(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(tx.quoted_csv(F.col("text")).cast("binary")).alias("field"))


@query("colors", """
SELECT p_partkey, '#' || printf('%02x%02x%02x', p_partkey % 256, p_size, (p_partkey * 7) % 256) AS hex, 'rgba(' || CAST(p_size AS VARCHAR) || ',0,255,' || CAST(round(p_size / 255.0, 2) AS VARCHAR) || ')' AS rgba
FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part)""".replace("CAST(round(p_size / 255.0, 2) AS VARCHAR)", "CAST(round(CAST(p_size AS DOUBLE) / 255.0, 2) AS VARCHAR)"))
def colors(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    return read(spark, d, "part").select("p_partkey", bn.hex_color(k % 256, s, (k * 7) % 256).alias("hex"), bn.rgba_color(s, F.lit(0), F.lit(255), s).alias("rgba"))


@query("integer_reads", """
SELECT c_custkey, (ascii(c_name) * 256 + ascii(substr(c_name, 2))) AS big, (ascii(substr(c_name, 2)) * 256 + ascii(c_name)) AS little, (ascii(c_name) * 256 + ascii(substr(c_name, 2))) / 256.0 AS fixed,
  ascii(c_name) // 16 AS high, ascii(c_name) % 16 AS low FROM customer""".replace("(ascii(c_name) * 256 + ascii(substr(c_name, 2))) AS big", "CAST(ascii(c_name) * 256 + ascii(substr(c_name, 2)) AS BIGINT) AS big").replace("(ascii(substr(c_name, 2)) * 256 + ascii(c_name)) AS little", "CAST(ascii(substr(c_name, 2)) * 256 + ascii(c_name) AS BIGINT) AS little").replace("/ 256.0 AS fixed", "/ CAST(256 AS DOUBLE) AS fixed").replace("ascii(c_name) // 16 AS high, ascii(c_name) % 16 AS low", "CAST(ascii(c_name) // 16 AS BIGINT) AS high, CAST(ascii(c_name) % 16 AS BIGINT) AS low"))
def integer_reads(spark, d):
    b = F.col("c_name").cast("binary")
    high, low = bn.nibbles(bn.unsigned(b, 0, 1))
    big = bn.unsigned(b, 0, 2)
    return read(spark, d, "customer").select("c_custkey", big.alias("big"), bn.unsigned(b, 0, 2, little=True).alias("little"), bn.fixed8(big).alias("fixed"), high.cast("long").alias("high"), low.cast("long").alias("low"))


@query("optics", """
SELECT p_partkey, sqrt(CAST(1872 AS DOUBLE)) / (s * 1440) AS confusion, f * f / (n * 0.03 * 1000) AS hyperfocal, p_size * 4000 / CAST(1000000 AS DOUBLE) AS megapixels
FROM (SELECT p_partkey, p_size, CAST(p_size + 10 AS DOUBLE) AS f, CAST(p_size % 7 + 1 AS DOUBLE) AS n, CAST(p_size % 3 + 1 AS DOUBLE) AS s FROM part)""".replace("0.03", "CAST(0.03 AS DOUBLE)"))
def optics(spark, d):
    size = F.col("p_size")
    f, n, s = (size + 10).cast("double"), (size % 7 + 1).cast("double"), (size % 3 + 1).cast("double")
    return read(spark, d, "part").select("p_partkey", nm.circle_of_confusion(s).alias("confusion"), nm.hyperfocal(f, n, F.lit(0.03)).alias("hyperfocal"), nm.megapixels(size, F.lit(4000)).alias("megapixels"))


@query("spoken_names", r"""
SELECT p_partkey, trim(regexp_replace(regexp_replace(replace(k, '_', ' '), '([a-z])([A-Z0-9])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')) AS shown
FROM (SELECT p_partkey, 'GPS' || p_brand || '_XResolution' AS k FROM part)""")
def spoken_names(spark, d):
    k = F.concat(F.lit("GPS"), F.col("p_brand"), F.lit("_XResolution"))
    return read(spark, d, "part").select("p_partkey", tx.spoken_name(k).alias("shown"))
