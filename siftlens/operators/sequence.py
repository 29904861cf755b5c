"""Operations along an order: carrying forward, sessions by marker, running sums, gaps, copies. Each is one shuffle by key
and one sort; keys are documents, users or tracks, never constants."""

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def along(keys: list[str], *order: str):
    return Window.partitionBy(*keys).orderBy(*order)


def so_far(keys: list[str], *order: str):
    return along(keys, *order).rowsBetween(Window.unboundedPreceding, 0)


def carried(value: Column, keys: list[str], *order: str) -> Column:
    """The last value up to here that is not null."""
    return F.last(value, ignorenulls=True).over(so_far(keys, *order))


def session_number(marker: Column, keys: list[str], *order: str) -> Column:
    """How many markers came before this row: a marker ends its session."""
    before = along(keys, *order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(marker.cast("long")).over(before), F.lit(0))


def running_with_reset(df: DataFrame, value: str, reset: Column, keys: list[str], *order: str, name: str = "running") -> DataFrame:
    """Running sums that start anew at each reset, the reset's own value included."""
    df = df.withColumn("reset_group", F.sum(reset.cast("long")).over(so_far(keys, *order)))
    return df.withColumn(name, F.sum(value).over(so_far([*keys, "reset_group"], *order))).drop("reset_group")


def previous(value: str, keys: list[str], *order: str) -> Column:
    return F.lag(value).over(along(keys, *order))


def running(value: str, keys: list[str], *order: str) -> Column:
    return F.sum(value).over(so_far(keys, *order))


def rolled_days(time_of_day: str, keys: list[str], *order: str, jitter: float = 2.0) -> tuple[Column, Column]:
    """A flag where the time of day falls by more than the jitter, as at midnight (to be summed with running())."""
    back = F.lag(time_of_day).over(along(keys, *order))
    flag = F.coalesce((back - F.col(time_of_day) > jitter).cast("long"), F.lit(0))
    return flag, back


def copy_number(keys: list[str], *order: str) -> Column:
    """0 for the first row of a key, 1 for its first copy, and so on."""
    return (F.row_number().over(along(keys, *order)) - 1).cast("long")


def chained(edges: DataFrame, keys: list[str], order: str, start: str, end: str) -> DataFrame:
    """Edges of a key with path and place: each path begins with the first edge by order that is on no path yet, and goes
    on with an edge that starts where the last one ends, the first of several by order, until it closes or nothing fits.
    Following edges is a walk, so a key's edges (one outline of a drawing) are one task's work."""
    kinds = T.StructType([*[edges.schema[c] for c in (*keys, order, start, end)], T.StructField("path", T.IntegerType()), T.StructField("place", T.IntegerType())])

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable").reset_index(drop=True)
        ahead: dict = {}
        for k in reversed(range(len(rows))):
            ahead.setdefault(rows[start][k], []).append(k)
        ends, used = rows[end].tolist(), [False] * len(rows)
        path, place = [0] * len(rows), [0] * len(rows)
        number = 0
        for first in range(len(rows)):
            if used[first]:
                continue
            k, n = first, 0
            while k is not None:
                used[k], path[k], place[k] = True, number, n
                n += 1
                free = ahead.get(ends[k], [])
                while free and used[free[-1]]:
                    free.pop()
                k = free.pop() if free and ends[k] != rows[start][first] else None
            number += 1
        return rows.assign(path=path, place=place)[[f.name for f in kinds]]

    return edges.select(*keys, order, start, end).groupBy(*keys).applyInPandas(walk, kinds)
