"""Values to lay over records, from CSV or JSON files: a key column `SourceFile`, others named after tags."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "SourceFile"


def _keyed(rows: DataFrame, missing: str | None) -> DataFrame:
    """Empty values are no values; a missing-value mark deletes, told by a null in `deleted`'s list. The last row of a key
    counts."""
    columns = [c for c in rows.columns if c not in (KEY, "row_no") and c.strip()]
    key = F.coalesce(F.nullif(F.col(KEY), F.lit("")), F.lit("*")) if KEY in rows.columns else F.lit("*")
    value = lambda c: F.when((F.col(f"`{c}`") != "") & (F.col(f"`{c}`") != (missing if missing is not None else "\0")), F.col(f"`{c}`"))
    gone = F.array_compact(F.array(*[F.when(F.col(f"`{c}`") == (missing if missing is not None else "\0"), F.lit(c)) for c in columns])) if columns else F.array()
    named = rows.select(key.alias(KEY), "row_no", *[value(c).alias(c) for c in columns], gone.cast("array<string>").alias("deleted"))
    best = named.groupBy(KEY).agg(F.max_by(F.struct(*[f"`{c}`" for c in columns], "deleted"), "row_no").alias("r"))
    return best.select(KEY, *[F.col(f"r.`{c}`").alias(c) for c in columns], F.col("r.deleted").alias("deleted"))


def read_csv(spark: SparkSession, path: str, missing: str | None = None, delimiter: str = ",") -> DataFrame:
    """Quoted fields may hold delimiters, line breaks and doubled quotes; a byte-order mark is dropped."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", delimiter).option("emptyValue", "").csv(path)
    rows = rows.toDF(*[c.lstrip("\ufeff") or f"_{k}" for k, c in enumerate(rows.columns)])
    return _keyed(rows.select(*[f"`{c}`" for c in rows.columns if not c.startswith("_")]).withColumn("row_no", F.monotonically_increasing_id()), missing)


def read_json(spark: SparkSession, path: str, missing: str | None = None) -> DataFrame:
    """An array of objects, or one. Values that begin with `base64:` are decoded as UTF-8."""
    rows = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    plain = lambda c: F.when(F.col(f"`{c}`").cast("string").startswith("base64:"), F.decode(F.unbase64(F.substring(F.col(f"`{c}`").cast("string"), 8, 1 << 30)), "UTF-8")).otherwise(F.col(f"`{c}`").cast("string"))
    return _keyed(rows.select(*[plain(c).alias(c) for c in rows.columns]).withColumn("row_no", F.monotonically_increasing_id()), missing)
