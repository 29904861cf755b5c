"""Aggregations over the driver's tables."""

from pyspark.sql import functions as F

from siftlens.operators import gather, sequence
from siftlens.plans.registry import query, read


@query("upsert_last_wins", """
SELECT user_id, arg_max(event_type, ts) AS event_type, arg_max(value, ts) FILTER (WHERE event_type = 'purchase') AS last_purchase FROM events GROUP BY user_id""")
def upsert_last_wins(spark, d):
    e = read(spark, d, "events").withColumn("last_purchase", F.when(F.col("event_type") == "purchase", F.col("value")))
    return gather.merge_latest(e, ["user_id"], ["ts", "event_id"], ["event_type", "last_purchase"])


@query("upsert_first_in_batch", """
SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1, 2""")
def upsert_first_in_batch(spark, d):
    o = read(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    first = gather.first_in_batch(o, ["o_custkey", "day"], ["o_orderkey"], ["o_orderkey", "o_totalprice"])
    return first


@query("bounding_box", """
SELECT user_id, least(0.0, min(value)) AS value_min, greatest(0.0, max(value)) AS value_max FROM events GROUP BY user_id""")
def bounding_box(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(*gather.box("value"))


@query("box_union", """
SELECT min(lo) AS lo, max(hi) AS hi, CAST(count(*) AS BIGINT) AS n FROM (SELECT user_id, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1)""")
def box_union(spark, d):
    each = read(spark, d, "events").groupBy("user_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return each.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n"))


@query("distinct_ordered", """
SELECT user_id, string_agg(event_type, ',' ORDER BY seen) AS types FROM (SELECT user_id, event_type, min(ts) AS seen FROM events GROUP BY 1, 2) GROUP BY 1""")
def distinct_ordered(spark, d):
    lists = gather.distinct_in_order(read(spark, d, "events"), ["user_id"], "event_type", "ts")
    return lists.select("user_id", F.array_join("event_type", ",").alias("types"))


@query("ordered_concat", """
SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS talk, count(*) AS n FROM conversations GROUP BY conv_id""")
def ordered_concat(spark, d):
    c = read(spark, d, "conversations").withColumn("line", F.concat("role", F.lit(": "), "text"))
    return c.groupBy("conv_id").agg(F.array_join(gather.in_order("line", "turn", "role", "text"), "\n").alias("talk"), F.count("*").alias("n"))


@query("stream_stats", """
SELECT user_id, count(*) AS frames, sum(value) > 0 AS any_data, count(*) * 20 AS duration, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS samples FROM events GROUP BY user_id""")
def stream_stats(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(
        F.count("*").alias("frames"), (F.sum("value") > 0).alias("any_data"), (F.count("*") * 20).alias("duration"), F.sum(F.floor("value")).alias("samples"))


@query("list_accumulate", "SELECT source, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM documents GROUP BY source")
def list_accumulate(spark, d):
    ids = read(spark, d, "documents").groupBy("source").agg(gather.in_order("doc_id", "doc_id").alias("ids"))
    return ids.select("source", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


_RANKED = """
SELECT md5(text) AS name, d.doc_id, coalesce(quality, 0) AS priority,
  CAST(row_number() OVER (PARTITION BY md5(text) ORDER BY coalesce(quality, 0) DESC, CASE WHEN coalesce(quality, 0) > 0 THEN d.doc_id END DESC, d.doc_id) - 1 AS BIGINT) AS copy
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


@query("priority_dedup", f"SELECT name, doc_id, priority FROM ({_RANKED}) WHERE copy = 0")
def priority_dedup(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("name"))
    marked = docs.join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    marked = marked.select("name", "doc_id", F.coalesce("quality", F.lit(0)).alias("priority"))
    return gather.deduplicate(marked, ["name"], "priority", "doc_id").select("name", "doc_id", "priority")


@query("priority_copies", _RANKED)
def priority_copies(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("name"))
    marked = docs.join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    marked = marked.select("name", "doc_id", F.coalesce("quality", F.lit(0)).alias("priority"))
    return marked.withColumn("copy", (gather.priority_rank(["name"], "priority", "doc_id") - 1).cast("long"))


_TYPES = ["cart", "click", "purchase", "signup", "view"]


@query("pivot_columns", "SELECT user_id, " + ", ".join(f"nullif(count(*) FILTER (WHERE event_type = '{t}'), 0) AS {t}" for t in _TYPES) + " FROM events GROUP BY user_id")
def pivot_columns(spark, d):
    return gather.widen(read(spark, d, "events"), "user_id", "event_type", F.nullif(F.count("value"), F.lit(0).cast("long")), _TYPES)


@query("column_union", "SELECT event_type AS name, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def column_union(spark, d):
    return read(spark, d, "events").select("event_type", "user_id").distinct().groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("users"))


@query("group_ordinal", """
SELECT o_orderpriority, CAST(dense_rank() OVER (ORDER BY first) AS INTEGER) AS place FROM (SELECT o_orderpriority, min(o_orderkey) AS first FROM orders GROUP BY 1)""")
def group_ordinal(spark, d):
    return gather.first_seen_rank(read(spark, d, "orders"), "o_orderpriority", ["o_orderkey"])


@query("run_counters", """
SELECT count(*) AS processed, count(*) FILTER (WHERE quality = 1) AS passed, count(*) FILTER (WHERE quality = 0) AS failed, count(*) FILTER (WHERE toxic = 1) AS bad FROM labels""")
def run_counters(spark, d):
    return read(spark, d, "labels").agg(
        F.count("*").alias("processed"), F.count_if(F.col("quality") == 1).alias("passed"), F.count_if(F.col("quality") == 0).alias("failed"), F.count_if(F.col("toxic") == 1).alias("bad"))


@query("digest_compare", """
SELECT lang, count(*) AS n, count(DISTINCT md5(text)) AS different FROM documents GROUP BY lang""")
def digest_compare(spark, d):
    hashed = read(spark, d, "documents").groupBy("lang", F.md5(F.col("text").cast("binary")).alias("digest")).agg(F.count("*").alias("c"))
    return hashed.groupBy("lang").agg(F.sum("c").alias("n"), F.count("*").alias("different"))


@query("max_over_parts", """
SELECT vec_id, CAST(list_max(embedding) AS DOUBLE) AS most, CAST(list_min(embedding) AS DOUBLE) AS least, CAST(len(embedding) AS BIGINT) AS n FROM embeddings""")
def max_over_parts(spark, d):
    e = F.col("embedding")
    return read(spark, d, "embeddings").select("vec_id", F.array_max(e).cast("double").alias("most"), F.array_min(e).cast("double").alias("least"), F.size(e).cast("long").alias("n"))


@query("edges_by_style", """
SELECT style, string_agg(CAST(edge AS VARCHAR), ',' ORDER BY side, seq) AS edges FROM (
  SELECT p_size % 7 AS style, 0 AS side, p_partkey AS seq, p_partkey AS edge FROM part
  UNION ALL SELECT p_size % 5, 1, -p_partkey, -p_partkey FROM part) GROUP BY style""")
def edges_by_style(spark, d):
    p = read(spark, d, "part")
    right = p.select((F.col("p_size") % 7).alias("style"), F.lit(0).alias("side"), F.col("p_partkey").alias("seq"), F.col("p_partkey").alias("edge"))
    left = p.select((F.col("p_size") % 5).alias("style"), F.lit(1).alias("side"), (-F.col("p_partkey")).alias("seq"), (-F.col("p_partkey")).alias("edge"))
    lists = right.unionByName(left).groupBy("style").agg(gather.in_order("edge", "side", "seq").alias("edges"))
    return lists.select("style", F.array_join(F.transform("edges", lambda x: x.cast("string")), ",").alias("edges"))


@query("copy_number", """
SELECT doc_id, CAST(row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) - 1 AS BIGINT) AS copy FROM documents""")
def copy_number(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    return docs.select("doc_id", sequence.copy_number(["digest"], "doc_id").alias("copy"))
