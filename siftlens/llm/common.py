"""What the operators of this subpackage share: reading, lineage cuts, whole rows as one column, bounded driver reads."""

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir or the context's checkpoint folder names it. Where neither
    is set, a local session (a test) gets a temporary folder, one for each application; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = set_.get() if set_.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = f"file://{tempfile.mkdtemp(prefix='siftlens-')}"
        found = _own[app]
    return found.rstrip("/")


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/siftlens/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = f"{_tables(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has stored. Results that were not yet read depend on them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def quoted(column: str) -> Column:
    """A column by its whole name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def whole(docs: DataFrame) -> Column:
    """All columns of a row as one struct, so that no name can clash; its fields are numbered."""
    return F.struct(*[quoted(c).alias(f"c{k}") for k, c in enumerate(docs.columns)])


def unpacked(rows: DataFrame, docs: DataFrame, column: str = "row", **instead: Column) -> DataFrame:
    """The columns of docs again, from their struct; `instead` gives other values for some."""
    return rows.select(*[instead.get(c, F.col(f"`{column}`.`c{k}`")).alias(c) for k, c in enumerate(docs.columns)])


def text_of(batch: pa.RecordBatch, column: str, at: int | None) -> pa.Array:
    """A batch's texts: a column of its own, or a field of the struct that holds whole rows."""
    return batch.column(column) if at is None else pc.struct_field(batch.column(column), [at])


def cuts_by_bytes(texts: pa.Array, most: int, rows: int) -> list[tuple[int, int]]:
    """Ranges of a batch's rows, of about `most` bytes of text (or one row) and `rows` rows at most."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    out, start, held = [], 0, 0
    for k, n in enumerate(sizes):
        if k > start and (held + n > most or k - start >= rows):
            out.append((start, k))
            start, held = k, 0
        held += n
    return [*out, (start, len(sizes))] if sizes else []


def released(run: Callable) -> Callable:
    """A function over batches that gives free memory back to the system at its end, as a worker lives on."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return runs


def hashed_share(column, share: float):
    """True for a deterministic share of rows, chosen by a hash of the column."""
    span = 1 << 40
    return F.pmod(F.xxhash64(column), F.lit(span)) < F.lit(int(min(1.0, share) * span))
