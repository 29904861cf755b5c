"""Filters, projections, lookups, overlays and set operations over the driver's tables."""

from pyspark.sql import functions as F

from siftlens.functions import text as tx
from siftlens.operators import gather, lookup, rows
from siftlens.plans.registry import query, read
from siftlens.sources import html


@query("ext_filter", r"""
SELECT page_id, lower(regexp_extract(url, '\.([^./?#]+)(?:[?#].*)?$', 1)) AS ext FROM pages
WHERE lower(regexp_extract(url, '\.([^./?#]+)(?:[?#].*)?$', 1)) IN ('html', 'htm')""")
def ext_filter(spark, d):
    return read(spark, d, "pages").select("page_id", tx.extension(F.col("url")).alias("ext")).where(F.col("ext").isin("html", "htm"))


@query("ordered_classify", """
SELECT doc_id, CASE WHEN starts_with(text, '<') THEN 'markup' WHEN regexp_matches(text, '^[0-9]') THEN 'number'
  WHEN contains(text, '|') THEN 'table' WHEN regexp_matches(substr(text, 1, 50), '[A-Z]{4}') THEN 'shout' ELSE 'prose' END AS kind FROM documents""")
def ordered_classify(spark, d):
    t = F.col("text")
    kind = (
        F.when(t.startswith("<"), "markup").when(t.rlike("^[0-9]"), "number").when(F.contains(t, F.lit("|")), "table")
        .when(F.substring(t, 1, 50).rlike("[A-Z]{4}"), "shout").otherwise("prose")
    )
    return read(spark, d, "documents").select("doc_id", kind.alias("kind"))


_HEAD = r"""
WITH h AS (SELECT page_id, regexp_extract(html, '(?is)<head[^>]*>(.*?)</head>', 1) AS head, regexp_extract(html, '(?is)<html[^>]*\blang="([^"]*)"', 1) AS lang FROM pages)
"""


@query("html_head_tags", _HEAD + r"""
SELECT page_id, nullif(regexp_extract(head, '(?is)<title[^>]*>(.*?)</title>', 1), '') AS title, nullif(lang, '') AS lang,
  nullif(lower(regexp_extract(head, '(?is)<meta[^>]*\bcharset="?([\w-]+)', 1)), '') AS charset FROM h""")
def html_head_tags(spark, d):
    h = html.head("html")
    return read(spark, d, "pages").select("page_id", h["title"].alias("title"), h["lang"].alias("lang"), h["charset"].alias("charset"))


@query("html_meta_long", _HEAD + r"""
SELECT page_id, 'title' AS name, regexp_extract(head, '(?is)<title[^>]*>(.*?)</title>', 1) AS value FROM h WHERE regexp_matches(head, '(?is)<title[^>]*>.+?</title>')
UNION ALL SELECT page_id, 'lang', lang FROM h WHERE lang <> ''
UNION ALL SELECT page_id, 'charset', lower(regexp_extract(head, '(?is)<meta[^>]*\bcharset="?([\w-]+)', 1)) FROM h WHERE regexp_matches(head, '(?is)<meta[^>]*\bcharset="?[\w-]+')""")
def html_meta_long(spark, d):
    return html.head_tags(read(spark, d, "pages"), "page_id", "html").select("page_id", "name", "value")


@query("head_tags_wide", _HEAD + r"""
SELECT page_id, nullif(lower(regexp_extract(head, '(?is)<meta[^>]*\bcharset="?([\w-]+)', 1)), '') AS "Charset", nullif(lang, '') AS "Language",
  nullif(regexp_extract(head, '(?is)<title[^>]*>(.*?)</title>', 1), '') AS "Title" FROM h
WHERE regexp_matches(head, '(?is)<title[^>]*>.+?</title>') OR lang <> '' OR regexp_matches(head, '(?is)<meta[^>]*\bcharset="?[\w-]+')""")
def head_tags_wide(spark, d):
    """Source, decode, lookup, choice and wide rows, without a shuffle."""
    return html.head_wide(read(spark, d, "pages"), "page_id", "html", {"title": "Title", "lang": "Language", "charset": "Charset"})


@query("if_condition", """
SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE coalesce(quality = 1 AND toxic = 0 AND n_chars > 500, false)""")
def if_condition(spark, d):
    both = read(spark, d, "documents").select("doc_id", "n_chars").join(read(spark, d, "labels"), "doc_id", "left")
    return rows.keep_if(both, F.col("quality") == 1, F.col("toxic") == 0, F.col("n_chars") > 500).select("doc_id", "quality")


_EAV = """(SELECT p_partkey, 'p_brand' AS tag, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part)"""


@query("group_filter", f"""
SELECT p_partkey, tag, value FROM {_EAV} WHERE (tag = 'p_brand' AND lower(value) = 'brand#12') OR (tag = 'p_type' AND lower(value) LIKE 'promo%')""")
def group_filter(spark, d):
    eav = read(spark, d, "part").select("p_partkey", F.expr("stack(2, 'p_brand', p_brand, 'p_type', p_type) as (tag, value)"))
    families = F.array(F.col("tag"), F.when(F.col("tag") == "p_brand", F.col("value")).otherwise(F.when(F.lower("value").startswith("promo"), F.lit("promo"))))
    return eav.where(rows.in_family(families, "Brand#12") | rows.in_family(families, "PROMO"))


@query("quality_cut", "SELECT event_id, user_id, nullif(value, 100.0) AS cut FROM events WHERE value = 100.0 OR value <= 120.0")
def quality_cut(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", F.nullif(F.col("value"), F.lit(100.0)).alias("cut"))
    return e.where(rows.at_most("cut", 120.0))


@query("exclude_set", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def exclude_set(spark, d):
    gone = read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return rows.exclude(read(spark, d, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey").select("o_orderkey", "o_custkey")


@query("wildcard_select", "SELECT l_orderkey, l_extendedprice FROM lineitem")
def wildcard_select(spark, d):
    return rows.select_matching(read(spark, d, "lineitem"), "L_*price", "l_?rderkey", "l_ship*", without=("*date",))


@query("missing_as_null", "SELECT c_custkey, c_name, CAST(NULL AS VARCHAR) AS c_phone FROM customer")
def missing_as_null(spark, d):
    return rows.select_or_null(read(spark, d, "customer"), c_custkey="bigint", c_name="string", c_phone="string")


@query("derived_columns", """
SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, CAST(NULL AS DOUBLE) AS margin FROM lineitem""")
def derived_columns(spark, d):
    made = rows.derive(
        read(spark, d, "lineitem"),
        charge=(("net", "l_tax"), lambda net, tax: net * (1 + tax)),
        net=(("l_extendedprice", "l_discount"), lambda price, off: price * (1 - off)),
        margin=(("net", "l_cost"), lambda net, cost: net - cost),
    )
    return made.select("l_orderkey", "l_linenumber", "net", "charge", F.col("margin").cast("double").alias("margin"))


@query("label_join_fallback", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' ELSE 'Unknown (' || o_orderstatus || ')' END AS status FROM orders""")
def label_join_fallback(spark, d):
    labels = spark.createDataFrame([("F", "Finished"), ("O", "Open")], "code string, label string")
    return lookup.join_labels(read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), labels, "o_orderstatus").select("o_orderkey", F.col("label").alias("status"))


@query("reverse_lookup", """
WITH w(wanted) AS (VALUES ('FRANCE'), ('germany'), ('united'), ('IND'), ('an'), ('zz')),
p AS (SELECT wanted, n_nationkey AS code, CASE WHEN n_name = wanted THEN 0 WHEN lower(n_name) = lower(wanted) THEN 1
  WHEN starts_with(lower(n_name), lower(wanted)) THEN 2 ELSE 3 END AS fit FROM w JOIN nation ON contains(lower(n_name), lower(wanted))),
b AS (SELECT wanted, min(fit) AS fit FROM p GROUP BY wanted)
SELECT w.wanted, CASE WHEN count(code) = 1 THEN min(code) END AS code, count(code) AS n_fits
FROM w LEFT JOIN (SELECT p.* FROM p JOIN b ON p.wanted = b.wanted AND p.fit = b.fit) q ON w.wanted = q.wanted GROUP BY w.wanted""")
def reverse_lookup(spark, d):
    wanted = spark.createDataFrame([(x,) for x in ("FRANCE", "germany", "united", "IND", "an", "zz")], "wanted string")
    return lookup.codes_of(wanted, read(spark, d, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("label")))


@query("bitmask_labels", """
SELECT l_linenumber, count(*) AS n, CASE WHEN l_linenumber = 0 THEN '(none)' ELSE concat_ws(', ', CASE WHEN l_linenumber & 1 > 0 THEN 'one' END,
  CASE WHEN l_linenumber & 2 > 0 THEN 'two' END, CASE WHEN l_linenumber & 4 > 0 THEN '[2]' END) END AS bits FROM lineitem GROUP BY l_linenumber""")
def bitmask_labels(spark, d):
    n = read(spark, d, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("n"))
    return n.withColumn("bits", lookup.bit_labels(F.col("l_linenumber"), {0: "one", 1: "two"}))


@query("dict_join", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name, s_name, n_name FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey""")
def dict_join(spark, d):
    suppliers = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    lines = lines.join(read(spark, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return lines.join(suppliers.select("s_suppkey", "s_name", "n_name"), F.col("l_suppkey") == F.col("s_suppkey"), "left").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_name", "s_name", "n_name")


@query("broadcast_scalar", "SELECT o_orderkey, o_totalprice / (SELECT max(o_totalprice) FROM orders) AS share FROM orders")
def broadcast_scalar(spark, d):
    o = read(spark, d, "orders")
    top = o.agg(F.max("o_totalprice").alias("top"))  # one row
    return o.select("o_orderkey", "o_totalprice").crossJoin(F.broadcast(top)).select("o_orderkey", (F.col("o_totalprice") / F.col("top")).alias("share"))


@query("orphan_frames", "SELECT doc_id, source FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def orphan_frames(spark, d):
    return read(spark, d, "documents").select("doc_id", "source").join(read(spark, d, "labels"), "doc_id", "left_anti")


@query("attach_to_parent", """
SELECT p_partkey, p_name, n_lines, last_ship FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n_lines, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1) ON p_partkey = l_partkey""")
def attach_to_parent(spark, d):
    child = read(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n_lines"), F.max("l_shipdate").alias("last_ship"))
    return read(spark, d, "part").select("p_partkey", "p_name").join(child, F.col("p_partkey") == F.col("l_partkey"), "left").drop("l_partkey")


@query("index_join", """
SELECT vec_id, CAST(i - 1 AS BIGINT) AS place, CAST(embedding[i] AS DOUBLE) AS component FROM (SELECT vec_id, embedding, label, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) WHERE i - 1 = label""")
def index_join(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("place", "component"))
    return e.where(F.col("place") == F.col("label")).select("vec_id", F.col("place").cast("long").alias("place"), F.col("component").cast("double").alias("component"))


@query("union_overwrite", """
WITH s AS (SELECT o_orderkey, o_orderpriority AS priority, 0 AS rank FROM orders WHERE o_orderstatus <> 'P'
  UNION ALL SELECT o_orderkey, upper(o_orderstatus), 1 FROM orders WHERE o_orderstatus <> 'F')
SELECT o_orderkey, max_by(priority, rank) AS priority FROM s GROUP BY o_orderkey""")
def union_overwrite(spark, d):
    o = read(spark, d, "orders")
    one = o.where("o_orderstatus <> 'P'").select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.lit(0).alias("rank"))
    two = o.where("o_orderstatus <> 'F'").select("o_orderkey", F.upper("o_orderstatus").alias("priority"), F.lit(1).alias("rank"))
    return gather.merge_latest(one.unionByName(two), ["o_orderkey"], ["rank"], ["priority"])


@query("list_add_remove", """
SELECT doc_id, array_to_string(list_filter(string_split(text, ' '), lambda x : x <> 'the') || ['end'], ' ') AS tokens FROM documents""")
def list_add_remove(spark, d):
    kept = F.concat(lookup.without(F.split("text", " "), F.lit("the")), F.array(F.lit("end")))
    return read(spark, d, "documents").select("doc_id", F.array_join(kept, " ").alias("tokens"))


@query("overlay_import", """
WITH i(k, lang, source) AS (SELECT CAST(doc_id AS VARCHAR), CASE WHEN toxic = 1 THEN 'xx' END, CASE WHEN quality = 0 THEN 'bad' END FROM labels UNION ALL SELECT '*', NULL, 'default')
SELECT doc_id, coalesce(e.lang, a.lang, d.lang) AS lang, coalesce(e.source, a.source, d.source) AS source
FROM documents d LEFT JOIN (SELECT * FROM i WHERE k <> '*') e ON CAST(d.doc_id AS VARCHAR) = e.k CROSS JOIN (SELECT * FROM i WHERE k = '*') a""")
def overlay_import(spark, d):
    marks = read(spark, d, "labels").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.when(F.col("toxic") == 1, "xx").alias("lang"), F.when(F.col("quality") == 0, "bad").alias("source"))
    every = spark.createDataFrame([("*", None, "default")], "doc_id string, lang string, source string")
    return lookup.overlay(read(spark, d, "documents").select("doc_id", "lang", "source"), marks.unionByName(every), "doc_id", ["lang", "source"])


@query("conditional_replace", """
SELECT p_partkey, CASE WHEN p_brand = 'Brand#13' THEN 'Brand#99' ELSE p_brand END AS p_brand, CAST(p_size + 5 AS INTEGER) AS p_size, CASE WHEN p_size > 40 THEN NULL ELSE p_retailprice END AS p_retailprice FROM part""")
def conditional_replace(spark, d):
    return read(spark, d, "part").select(
        "p_partkey", lookup.replace_if(F.col("p_brand"), F.lit("Brand#13"), F.lit("Brand#99")).alias("p_brand"), (F.col("p_size") + 5).alias("p_size"),
        F.when(~(F.col("p_size") > 40), F.col("p_retailprice")).alias("p_retailprice"))


@query("write_modes", """
SELECT coalesce(c.c_custkey, n.k) AS c_custkey, CASE WHEN n.k IS NULL THEN c.c_mktsegment ELSE coalesce(n.seg, c.c_mktsegment) END AS c_mktsegment,
  CASE WHEN n.k IS NULL THEN 'kept' WHEN c.c_custkey IS NULL THEN 'created' ELSE 'updated' END AS how
FROM customer c FULL JOIN (SELECT DISTINCT o_custkey + 100 AS k, 'NEW' AS seg FROM orders WHERE o_orderstatus = 'P') n ON c.c_custkey = n.k""")
def write_modes(spark, d):
    new = read(spark, d, "orders").where("o_orderstatus = 'P'").select((F.col("o_custkey") + 100).alias("k"), F.lit("NEW").alias("seg")).distinct()
    both = read(spark, d, "customer").select("c_custkey", "c_mktsegment").join(new, F.col("c_custkey") == F.col("k"), "full")
    how = F.when(F.col("k").isNull(), "kept").when(F.col("c_custkey").isNull(), "created").otherwise("updated")
    return both.select(F.coalesce("c_custkey", "k").alias("c_custkey"), F.coalesce("seg", "c_mktsegment").alias("c_mktsegment"), how.alias("how"))
