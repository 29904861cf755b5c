"""Numbers, binary fields and texts over the driver's tables: how they are read and shown."""

from pyspark.sql import functions as F

from siftlens.functions import binary as bn
from siftlens.functions import numeric as nm
from siftlens.functions import text as tx
from siftlens.plans.registry import query, read


@query("float_reads", """
SELECT p_partkey, (CASE WHEN p_size % 2 = 1 THEN -1 ELSE 1 END) * (1 + (p_partkey * 8191 % 8388608) / CAST(8388608 AS DOUBLE)) * pow(CAST(2 AS DOUBLE), p_size - 25) AS single,
  (1 + (p_partkey % 1048576) / CAST(1048576 AS DOUBLE)) * pow(CAST(2 AS DOUBLE), p_size - 10) AS double_ FROM part""")
def float_reads(spark, d):
    p, k, s = read(spark, d, "part"), F.col("p_partkey"), F.col("p_size")
    single = (s % 2).cast("long") * F.lit(1 << 31) + (s + 102).cast("long") * F.lit(1 << 23) + k * 8191 % F.lit(1 << 23)
    high = (s + 1013).cast("long") * F.lit(1 << 20) + k % F.lit(1 << 20)
    return p.select("p_partkey", bn.float32(single).alias("single"), bn.float64(high, F.lit(0)).alias("double_"))


@query("varint_reads", "SELECT p_partkey, p_partkey * 131 AS value FROM part")
def varint_reads(spark, d):
    n, low = F.col("p_partkey") * 131, F.lit(127)
    byte = lambda k: F.shiftright(n, 7 * k).bitwiseAND(low) + F.when(F.shiftright(n, 7 * (k + 1)) > 0, 128).otherwise(0)
    data = F.unhex(F.concat(*[F.lpad(F.hex(byte(k)), 2, "0") for k in range(5)]))
    return read(spark, d, "part").select("p_partkey", bn.varint(data).alias("value"))


@query("argb_gradients", "SELECT p_partkey, '#' || printf('%02x%02x%02x%02x', 255 - p_size, p_size, 0, p_partkey % 256) AS argb, p_size / CAST(256 AS DOUBLE) AS stop FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part)")
def argb_gradients(spark, d):
    s = F.col("p_size")
    return read(spark, d, "part").select("p_partkey", bn.argb_color(255 - s, s, F.lit(0), F.col("p_partkey") % 256).alias("argb"), bn.gradient_offset(s).alias("stop"))


@query("thousands", "SELECT o_orderkey, format('{:,}', o_orderkey * 7919) AS shown, CAST(round(100.0 * (o_orderkey % 37) / 37) AS BIGINT) AS share FROM orders")
def thousands(spark, d):
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select("o_orderkey", nm.thousands(k * 7919).alias("shown"), nm.percent(k % 37, F.lit(37)).alias("share"))


@query("rational", """
SELECT p_partkey, CASE WHEN s % 2 = 1 THEN '-' ELSE '' END || CAST(n // gcd(n, s) AS VARCHAR) || '/' || CAST(s // gcd(n, s) AS VARCHAR) AS shown
FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS s, p_partkey % 911 + 1 AS n FROM part)""")
def rational(spark, d):
    s, n = F.col("p_size"), F.col("p_partkey") % 911 + 1
    return read(spark, d, "part").select("p_partkey", nm.rational(F.when(s % 2 == 1, -1).otherwise(1) * n / s).alias("shown"))


@query("camera_values", """
SELECT p_partkey, CASE WHEN s % 3 = 0 THEN -a ELSE a END AS altitude, CASE WHEN s = 25 THEN 'Normal' WHEN s > 25 THEN '+' || CAST(s - 25 AS VARCHAR) ELSE CAST(s - 25 AS VARCHAR) END AS contrast,
  s / ((CAST(s + 1 AS DOUBLE) + s + 3) / 2) AS red, (s + 7) / ((CAST(s + 1 AS DOUBLE) + s + 3) / 2) AS blue,
  CASE WHEN s % 2 = 0 THEN (s * 3) / CAST(s AS DOUBLE) ELSE sqrt(CAST(1872 AS DOUBLE)) / s END AS scale
FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS s, p_retailprice AS a FROM part)""")
def camera_values(spark, d):
    s = F.col("p_size")
    levels = F.array(s, s + 1, s + 3, s + 7)
    return read(spark, d, "part").select(
        "p_partkey", nm.altitude(F.col("p_retailprice"), F.when(s % 3 == 0, F.lit("Below Sea Level")).otherwise("0")).alias("altitude"), nm.parameter(s - 25).alias("contrast"),
        nm.channel_balance(levels, 0).alias("red"), nm.channel_balance(levels, 2).alias("blue"), nm.scale_to_35mm(s.cast("double"), F.when(s % 2 == 0, s * 3), s.cast("double")).alias("scale"))


@query("alpha_numbers", """
SELECT o_orderkey, CASE WHEN k < 26 THEN '' WHEN k < 702 THEN chr(CAST(97 + (k - 26) // 26 AS INTEGER)) ELSE chr(CAST(97 + (k - 702) // 676 AS INTEGER)) || chr(CAST(97 + (k - 702) // 26 % 26 AS INTEGER)) END || chr(CAST(97 + CASE WHEN k < 26 THEN k WHEN k < 702 THEN (k - 26) % 26 ELSE (k - 702) % 26 END AS INTEGER)) AS letters
FROM (SELECT o_orderkey, o_orderkey * 31 % 18278 AS k FROM orders)""")
def alpha_numbers(spark, d):
    return read(spark, d, "orders").select("o_orderkey", tx.letters_of(F.col("o_orderkey") * 31 % 18278).alias("letters"))


@query("numeric_entities", "SELECT doc_id, left(text, 20) || chr(CAST(n AS INTEGER)) || 'é' || '&#xD800;' || 'z' AS shown FROM (SELECT doc_id, text, 161 + doc_id % 40000 AS n FROM documents)")
def numeric_entities(spark, d):
    n = F.col("doc_id") % 40000 + 161
    text = F.concat(F.left("text", F.lit(20)), F.when(n % 2 == 0, F.concat(F.lit("&#"), n.cast("string"))).otherwise(F.concat(F.lit("&#x"), F.lower(F.hex(n)))), F.lit(";&#233;&#xD800;z"))
    return read(spark, d, "documents").select("doc_id", tx.entities_unescaped(text).alias("shown"))


@query("quoted_lists", """
SELECT p_partkey, array_to_string(list_transform([p_brand, p_type || '; more', 'a "b"', p_name], lambda x : CASE WHEN regexp_matches(x, '[;"]') THEN '"' || replace(x, '"', '""') || '"' ELSE x END), '; ') AS text, true AS back FROM part""")
def quoted_lists(spark, d):
    p = read(spark, d, "part").withColumn("values", F.array("p_brand", F.concat("p_type", F.lit("; more")), F.lit('a "b"'), "p_name"))
    text = tx.joined_list(F.col("values"))
    return p.select("p_partkey", text.alias("text"), (tx.split_list(text) == F.col("values")).alias("back"))


@query("cell_patterns", """
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '[Red,Green][Green,Blue]' WHEN 1 THEN '[Cyan,Magenta,Yellow]' END AS shown FROM part""")
def cell_patterns(spark, d):
    by = F.col("p_size") % 3
    return read(spark, d, "part").select("p_partkey", tx.cell_pattern(F.when(by == 0, "2 2 0 1 1 2").when(by == 1, "3 1 3 4 5").otherwise("2 2 0 1")).alias("shown"))


@query("charset_decode", """
SELECT doc_id, md5(t) AS wide, md5(t) AS latin, md5(t) AS mac FROM (SELECT doc_id, regexp_replace(text, '[^\\x01-\\x7F]', '?', 'g') AS t FROM documents)""".replace("\\\\", "\\"))
def charset_decode(spark, d):
    t = F.regexp_replace("text", r"[^\x01-\x7F]", "?")
    digest = lambda x: F.md5(x.cast("binary"))
    return read(spark, d, "documents").select("doc_id", digest(tx.charset_decoded(F.encode(t, "UTF-16LE"), "UTF-16LE")).alias("wide"), digest(tx.charset_decoded(F.encode(t, "ISO-8859-1"), "ISO-8859-1")).alias("latin"), digest(tx.charset_decoded(t.cast("binary"), "mac_roman")).alias("mac"))


@query("light_and_view", """
SELECT p_partkey, round(log2(n * n * 100 / (0.5 * f)), 9) AS light, round(degrees(2 * atan(36.0 / (2 * f * 1.5))), 9) AS degrees
FROM (SELECT p_partkey, CAST(p_size + 10 AS DOUBLE) AS f, CAST(p_size % 7 + 1 AS DOUBLE) AS n FROM part)""")
def light_and_view(spark, d):
    f, n = (F.col("p_size") + 10).cast("double"), (F.col("p_size") % 7 + 1).cast("double")
    return read(spark, d, "part").select("p_partkey", F.round(nm.light_value(n, F.lit(0.5), f), 9).alias("light"), F.round(nm.field_of_view(f, F.lit(1.5)), 9).alias("degrees"))
