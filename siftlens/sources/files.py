"""Files as rows: path, extension, size, bytes. Decoders are functions of bytes that give rows; they run over Arrow
batches, a file at a time, so files are spread over tasks and a file's bytes are in one task only."""

import bz2
import json
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlens.functions.text import extension

Decoder = Callable[[bytes], Iterator[dict]]


def files(spark: SparkSession, path: str | list[str], accept: tuple[str, ...] = (), reject: tuple[str, ...] = (), recursive: bool = True) -> DataFrame:
    """Files below a path. accept and reject are extensions without a dot, in any case; hidden folders are left out."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    found = read.load(path).select("path", F.col("length").alias("size"), "content").withColumn("extension", extension(F.col("path")))
    found = found.where(~F.col("path").rlike(r"/\.[^/]+/"))
    if accept and "*" not in accept:
        found = found.where(F.col("extension").isin([x.lower() for x in accept]))
    return found.where(~F.col("extension").isin([x.lower() for x in reject])) if reject else found


#: What all decoders give: where in the file's tree a row stands, its order and place, code and name, size, and its
#: fields as JSON text (read with parse_json), and what went wrong.
RECORD = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("parent_path", T.StringType()), T.StructField("seq", T.IntegerType()), T.StructField("offset", T.LongType()),
    T.StructField("code", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("size", T.LongType()), T.StructField("fields", T.StringType()), T.StructField("error", T.StringType()),
])
_ARROW = pa.schema([("path", pa.string()), ("parent_path", pa.string()), ("seq", pa.int32()), ("offset", pa.int64()), ("code", pa.int32()), ("name", pa.string()), ("size", pa.int64()), ("fields", pa.string()), ("error", pa.string())])


def decoded(found: DataFrame, decoder: Decoder, batch_rows: int = 4096) -> DataFrame:
    """Rows of a decoder over files (path, content). A null content gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for seq, row in enumerate(decoder(content) if content is not None else ()):
                    fields = {k: v for k, v in row.pop("fields", {}).items() if v is not None}
                    held.append({"path": path, "parent_path": "", "seq": seq, "fields": json.dumps(fields), **row})
                    if len(held) >= batch_rows:
                        yield pa.RecordBatch.from_pylist(held, _ARROW)
                        held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, _ARROW)

    return found.select("path", "content").mapInArrow(run, RECORD)


#: Bytes that a packed file may give at most.
MOST_UNPACKED = 1 << 30


def inflated(data: bytes, wbits: int = 15, most: int = MOST_UNPACKED) -> bytes:
    """Inflated data; ValueError beyond `most` bytes, zlib.error where they are damaged."""
    machine = zlib.decompressobj(wbits)
    out = machine.decompress(data, most + 1)
    if len(out) > most:
        raise ValueError(f"more than {most} bytes")
    return out


def unpacked(found: DataFrame, most: int = MOST_UNPACKED) -> DataFrame:
    """Files (path, content) with those that are gzip or bzip2 by their first bytes unpacked, and the last extension of
    their path taken off; error where that fails or gives more than `most` bytes, and the content is null then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                error = None
                try:
                    if content is not None and content[:2] == b"\x1f\x8b":
                        path, content = path.removesuffix(".gz"), inflated(content, 31, most)
                    elif content is not None and content[:3] == b"BZh":
                        machine = bz2.BZ2Decompressor()
                        path, content = path.removesuffix(".bz2"), machine.decompress(content, most + 1)
                        if len(content) > most:
                            raise ValueError(f"more than {most} bytes")
                except (OSError, ValueError, zlib.error) as e:
                    content, error = None, str(e)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.binary()), pa.array([error], pa.string())], names=["path", "content", "error"])

    return found.select("path", "content").mapInArrow(run, "path string, content binary, error string")
