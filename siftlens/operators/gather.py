"""Aggregations: keyed merging, priority de-duplication, ordered lists, boxes, wide tables."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_latest(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """One row a key: of each column the latest value that is not null. Aggregates before the shuffle."""
    rank = F.struct(*order)
    latest = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), rank))
    return df.groupBy(*keys).agg(*[latest(c).alias(c) for c in columns])


def first_in_batch(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """One row a key: the values of the first row by order."""
    chosen = F.min(F.struct(*order, *[F.col(c).alias(f"own_{c}") for c in columns])).alias("first")
    return df.groupBy(*keys).agg(chosen).select(*keys, *[F.col(f"first.own_{c}").alias(c) for c in columns])


def priority_rank(keys: list[str], priority: str, order: str) -> Column:
    """Place among the rows of a key: highest priority first; among equals the latest, but of priority 0 the earliest."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(priority), F.when(F.col(priority) > 0, F.col(order)).desc(), F.asc(order)))


def deduplicate(df: DataFrame, keys: list[str], priority: str, order: str) -> DataFrame:
    """The row of each key that priority_rank() puts first, with a map-side aggregation instead of a window."""
    late = F.when(F.col(priority) > 0, F.col(order)).otherwise(-F.col(order))
    rank = F.struct(F.col(priority).alias("p"), late.alias("o"))
    others = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*others), rank).alias("best"))
    return best.select(*keys, *[F.col(f"best.{c}").alias(c) for c in others])


def in_order(value: str, *order: str) -> Column:
    """The values of a group as a list, by order."""
    pairs = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("own"))))
    return F.transform(pairs, lambda x: x["own"])


def distinct_in_order(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Distinct values of a key, in the order in which they first appear; aggregated by value before they meet."""
    seen = df.groupBy(*keys, value).agg(F.min(order).alias("seen"))
    return seen.groupBy(*keys).agg(in_order(value, "seen").alias(value))


def box(*columns: str) -> list[Column]:
    """Least and greatest of columns, 0 included."""
    return [x for c in columns for x in (F.least(F.lit(0.0), F.min(c)).alias(f"{c}_min"), F.greatest(F.lit(0.0), F.max(c)).alias(f"{c}_max"))]


def widen(df: DataFrame, key: str, name: str, value: Column, names: list[str] | None = None) -> DataFrame:
    """Rows of key, name, value as one row a key with a column for each name; without a list, those that occur."""
    names = names or [r[0] for r in df.select(name).distinct().orderBy(name).collect()]
    return df.groupBy(key).pivot(name, names).agg(value)


def first_seen_rank(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Each group's place by its first appearance, from 1."""
    first = df.groupBy(group).agg(F.min(F.struct(*order)).alias("seen"))
    return first.select(group, F.dense_rank().over(Window.orderBy("seen")).alias("place"))


def first_seen(infos: list[DataFrame], keys: list[str], columns: list[str]) -> DataFrame:
    """Of several tables, for each key the row of the first that has it; aggregated before the shuffle."""
    both = None
    for n, df in enumerate(infos):
        own = df.select(*keys, F.lit(n).alias("turn"), *columns)
        both = own if both is None else both.unionByName(own)
    best = both.groupBy(*keys).agg(F.min_by(F.struct(*columns), "turn").alias("best"))
    return best.select(*keys, *[F.col(f"best.{c}").alias(c) for c in columns])


def by_want(df: DataFrame, keys: list[str], group: str, wanted: list[str], order: str, columns: list[str]) -> DataFrame:
    """For each key the row whose group comes first among the wanted, and of these the latest; rows of other groups go."""
    place = F.array_position(F.array(*map(F.lit, wanted)), F.col(group))
    best = df.where(place > 0).groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(place, -F.col(order))).alias("best"))
    return best.select(*keys, *[F.col(f"best.{c}").alias(c) for c in columns])


def assembled(df: DataFrame, keys: list[str], index: str, total: str, chunk: str) -> DataFrame:
    """Binary chunks of a key put together by their index from 1; null where one is missing, or their number is stated
    unequally. A chunk that comes twice counts once. The chunks of a key meet in one row: they are parts of one file."""
    pairs = F.array_sort(F.collect_set(F.struct(F.col(index).alias("index"), F.col(chunk).alias("chunk"))))
    out = df.groupBy(*keys).agg(pairs.alias("pairs"), F.min(total).alias("least"), F.max(total).alias("most"))
    whole = F.unhex(F.array_join(F.transform("pairs", lambda x: F.hex(x["chunk"])), ""))
    there = (F.col("least") == F.col("most")) & (F.transform("pairs", lambda x: x["index"].cast("long")) == F.sequence(F.lit(1).cast("long"), F.col("most").cast("long")))
    return out.select(*keys, F.when(F.coalesce(there, F.lit(False)), whole).alias(chunk))
