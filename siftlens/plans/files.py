"""Queries over file contents, templates and drawings. The binary ones decode files that they make from the driver's
tables: a small image or animation for each row."""

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from siftlens.operators import gather
from siftlens.plans.registry import query, read
from siftlens.sinks import text as out
from siftlens.sources import jpeg, sniff, swf


@query("template_rows", """
SELECT 0 AS section, CAST(NULL AS BIGINT) AS o_orderkey, 0 AS line_no, '<orders>' AS line
UNION ALL SELECT 1, o_orderkey, 0, '<order id="' || CAST(o_orderkey AS VARCHAR) || '" status="' || o_orderstatus || '"/>' FROM orders UNION ALL SELECT 2, NULL, 0, '</orders>'""")
def template_rows(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return out.printed(o, ["<orders>"], ['<order id="$o_orderkey" status="${o_orderstatus}"/>', "<note>$absent</note>"], ["</orders>"], ["o_orderkey"])


@query("svg_path", """
WITH p AS (SELECT user_id, ts, event_id, CAST(floor(value / 50) AS BIGINT) AS x, CAST(length(event_type) AS BIGINT) AS y FROM events),
q AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, string_agg(CASE WHEN x0 IS NULL THEN 'M' || x || ' ' || y WHEN y = y0 THEN 'H' || x WHEN x = x0 THEN 'V' || y ELSE 'L' || x || ' ' || y END, ' ' ORDER BY ts, event_id) AS path FROM q GROUP BY user_id""")
def svg_path(spark, d):
    e = read(spark, d, "events").withColumn("point", F.struct(F.floor(F.col("value") / 50).alias("x"), F.length("event_type").cast("long").alias("y")))
    points = e.groupBy("user_id").agg(gather.in_order("point", "ts", "event_id").alias("points"))
    return points.select("user_id", out.svg_path(F.col("points")).alias("path"))


def _tiff(make: str, size: int) -> bytes:
    text = make.encode() + b"\0"
    rows = [struct.pack("<HHII", 0x10F, 2, len(text), 8 + 2 + 3 * 12 + 4), struct.pack("<HHIHH", 0x112, 3, 1, size % 8 + 1, 0), struct.pack("<HHII", 0x11A, 5, 1, 8 + 2 + 3 * 12 + 4 + len(text))]
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 3) + b"".join(rows) + b"\0\0\0\0" + text + struct.pack("<II", size, 2)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def image_of(make: str, size: int) -> bytes:
    """A small image file with a comment, Exif entries and a frame."""
    frame = struct.pack(">BHHB", 8, size, 2 * size, 1) + bytes([1, 0x11, 0])
    return b"\xff\xd8" + _segment(0xE0, b"JFIF\0" + struct.pack(">BBBHHBB", 1, 2, 1, 72, 72, 0, 0)) + _segment(0xE1, b"Exif\0\0" + _tiff(make, size)) + _segment(0xFE, make.encode()) + _segment(0xC0, frame) + b"\xff\xd9"


def movie_of(labels: list[str], packed: bool) -> bytes:
    """A small animation with a label for each frame."""

    def tag(code: int, body: bytes = b"") -> bytes:
        head = struct.pack("<H", code << 6 | min(len(body), 63))
        return head + (struct.pack("<I", len(body)) if len(body) >= 63 else b"") + body

    body = bytes([0x08, 0x00]) + struct.pack("<HH", 24 * 256, len(labels))
    body += tag(9, b"\x10\x20\x30") + b"".join(tag(43, x.encode() + b"\0") + tag(1) for x in labels) + tag(0)
    return (b"CWS" if packed else b"FWS") + bytes([8]) + struct.pack("<I", len(body) + 8) + (zlib.compress(body) if packed else body)


def _made(df, function, *columns: str):
    """path and content: a file for each row, made of its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in columns), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([function(*r) for r in rows], pa.binary())], names=["path", "content"])

    return df.select("path", *columns).mapInArrow(run, "path string, content binary")


def _images(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), "p_brand", "p_size")
    return _made(p, image_of, "p_brand", "p_size")


def _movies(spark, d):
    c = read(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("path")).agg(gather.in_order("role", "turn", "role", "text").alias("labels"))
    return _made(c.withColumn("packed", F.size("labels") % 2 == 0), movie_of, "labels", "packed")


@query("jpeg_segments", """
SELECT CAST(p_partkey AS VARCHAR) AS path, seq, name, CASE name WHEN 'COM' THEN p_brand WHEN 'SOF0' THEN CAST(p_size * 2 AS VARCHAR) || 'x' || CAST(p_size AS VARCHAR) WHEN 'APP0' THEN '1.02' END AS value
FROM part CROSS JOIN (VALUES (0, 'SOI'), (1, 'APP0'), (2, 'APP1'), (3, 'COM'), (4, 'SOF0'), (5, 'EOI')) AS s(seq, name)""")
def jpeg_segments(spark, d):
    s = jpeg.jpeg_segments(_images(spark, d))
    f = lambda k: F.get_json_object("fields", f"$.{k}")
    value = F.when(F.col("name") == "COM", f("comment")).when(F.col("name") == "SOF0", F.concat(f("width"), F.lit("x"), f("height"))).when(F.col("name") == "APP0", f("version"))
    return s.select("path", "seq", "name", value.alias("value"))


@query("exif_tags", """
SELECT CAST(p_partkey AS VARCHAR) AS path, tag, CASE tag WHEN 'Make' THEN p_brand WHEN 'Orientation' THEN
  ['top-left', 'top-right', 'bottom-right', 'bottom-left', 'left-top', 'right-top', 'right-bottom', 'left-bottom'][p_size % 8 + 1] END AS text, CASE WHEN tag = 'XResolution' THEN p_size / CAST(2 AS DOUBLE) END AS number
FROM part CROSS JOIN (VALUES ('Make'), ('Orientation'), ('XResolution')) AS t(tag)""")
def exif_tags(spark, d):
    e = jpeg.merged_tags(jpeg.exif_tags(_images(spark, d)))
    return e.select("path", "tag", F.coalesce("text", "label").alias("text"), F.when(F.col("tag") == "XResolution", F.col("value")[0]).alias("number"))


@query("swf_tags", """
WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS path, count(*) AS n FROM conversations GROUP BY 1)
SELECT path, name, CASE name WHEN 'FrameLabel' THEN n WHEN 'ShowFrame' THEN n ELSE 1 END AS tags FROM c CROSS JOIN (VALUES ('Header'), ('SetBackgroundColor'), ('FrameLabel'), ('ShowFrame'), ('End')) AS t(name)""")
def swf_tags(spark, d):
    return swf.swf_tags(_movies(spark, d)).groupBy("path", "name").agg(F.count("*").alias("tags"))


@query("swf_frames", """
SELECT CAST(conv_id AS VARCHAR) AS path, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS BIGINT) AS frame_no, role AS label FROM conversations""")
def swf_frames(spark, d):
    return swf.swf_frames(swf.swf_tags(_movies(spark, d))).select("path", F.col("frame_no").cast("long").alias("frame_no"), "label")


@query("binary_classify", """
SELECT kind, count(*) AS n FROM (SELECT 'JPEG' AS kind FROM part UNION ALL SELECT DISTINCT 'SWF' || CAST(conv_id AS VARCHAR) FROM conversations) GROUP BY kind""".replace("SELECT DISTINCT 'SWF' || CAST(conv_id AS VARCHAR) FROM conversations", "SELECT 'SWF' FROM (SELECT DISTINCT conv_id FROM conversations)"))
def binary_classify(spark, d):
    both = _images(spark, d).unionByName(_movies(spark, d))
    return both.select(jpeg.sniffed(F.col("content")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("magic_types", """
SELECT CASE WHEN starts_with(lower(html), '<!doctype html') THEN 'HTML' WHEN starts_with(html, '<') THEN 'XMP' END AS kind, count(*) AS n FROM pages GROUP BY 1
UNION ALL SELECT 'JPEG', count(*) FROM part UNION ALL SELECT 'SWF', count(DISTINCT conv_id) FROM conversations""")
def magic_types(spark, d):
    pages = read(spark, d, "pages").select(F.col("url").alias("path"), F.col("html").cast("binary").alias("content"))
    every = pages.unionByName(_images(spark, d)).unionByName(_movies(spark, d))
    return every.select(sniff.magic_type(F.col("content"), F.col("path")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("json_records", """
SELECT p_partkey, '{"key": ' || CAST(p_partkey AS VARCHAR) || ', "brand": "' || p_brand || '", "size": ' || CAST(p_size AS VARCHAR) || '}' AS line FROM part""")
def json_records(spark, d):
    p = read(spark, d, "part")
    return p.select("p_partkey", out.json_record({"key": F.col("p_partkey"), "brand": F.col("p_brand"), "absent": F.lit(None), "size": F.col("p_size")}).alias("line"))


@query("rdf_records", """
SELECT n_nationkey, '<rdf:Description rdf:about=''' || n_name || '''><place:Name>' || n_name || '</place:Name><key:Region>' || CAST(n_regionkey AS VARCHAR) || '</key:Region></rdf:Description>' AS line FROM nation""")
def rdf_records(spark, d):
    n = read(spark, d, "nation")
    return n.select("n_nationkey", out.rdf_record(F.col("n_name"), {"place": {"Name": F.col("n_name")}, "key": {"Region": F.col("n_regionkey"), "None": F.lit(None)}}).alias("line"))


@query("csv_lines", """
SELECT c_custkey, CAST(c_custkey AS VARCHAR) || ',' || c_name || ',,' || c_mktsegment AS line FROM customer""")
def csv_lines(spark, d):
    return read(spark, d, "customer").select("c_custkey", out.csv_line([F.col("c_custkey"), F.col("c_name"), F.lit(None), F.col("c_mktsegment")]).alias("line"))
