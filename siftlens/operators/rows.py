"""Choosing columns and rows: name patterns, missing columns, conditions, cuts, exclusions, derived columns."""

import fnmatch
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def matching(df: DataFrame, *patterns: str) -> list[str]:
    """Names of columns that match a pattern with * and ?, in any case, in the columns' order."""
    return [c for c in df.columns if any(fnmatch.fnmatchcase(c.lower(), p.lower()) for p in patterns)]


def select_matching(df: DataFrame, *patterns: str, without: tuple[str, ...] = ()) -> DataFrame:
    """Columns that match, less those that match an exclusion."""
    gone = {*matching(df, *without)} if without else set()
    return df.select(*[c for c in matching(df, *patterns) if c not in gone])


def select_or_null(df: DataFrame, **wanted: str) -> DataFrame:
    """The wanted columns (name: type); one that is absent is null."""
    have = {c.lower() for c in df.columns}
    return df.select(*[(F.col(c) if c.lower() in have else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()])


def keep_if(df: DataFrame, *conditions: Column) -> DataFrame:
    """Rows where all conditions hold; an undefined condition doesn't."""
    for c in conditions:
        df = df.where(F.coalesce(c, F.lit(False)))
    return df


def at_most(column: str, most: float) -> Column:
    """A quality cut that lets unknown values pass."""
    return F.col(column).isNull() | (F.col(column) <= most)


def exclude(df: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def in_family(families: Column, wanted: str) -> Column:
    """Whether some group of a row has a wanted name, in any case."""
    return F.exists(families, lambda x: F.lower(x) == wanted.lower())


def derive(df: DataFrame, **made: tuple[tuple[str, ...], Callable[..., Column]]) -> DataFrame:
    """Derived columns (name: inputs, function of them), each after those it needs. An input that neither the table nor
    another derived column has makes the column null."""
    left = dict(made)
    while left:
        ready = [n for n, (needs, _) in left.items() if not any(x in left for x in needs)]
        if not ready:
            raise ValueError(f"derived columns need each other: {sorted(left)}")
        df = df.withColumns({n: left[n][1](*map(F.col, left[n][0])) if {*left[n][0]} <= {*df.columns} else F.lit(None) for n in ready})
        for n in ready:
            del left[n]
    return df


def list_item(values: Column, n: int) -> Column:
    """The n-th item from 0, or from the end if negative; null beyond."""
    return F.try_element_at(values, F.lit(n + 1 if n >= 0 else n))


def snip(text: Column, most: int = 60) -> Column:
    """At most so many characters, the last of them telling that something was left out."""
    mark = "[snip]"
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - len(mark))), F.lit(mark))).otherwise(text)


def mixed_order(text: Column) -> list[Column]:
    """Sort keys: numbers first, by value; then texts with runs of digits padded to twelve; missing last."""
    number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.cast("double"))
    padded = F.regexp_replace(F.regexp_replace(F.lower(text), r"(\d+)", "000000000000$1"), r"0+(\d{12})(?!\d)", "$1")
    return [F.when(text.isNull(), 2).when(number.isNotNull(), 0).otherwise(1).asc(), number.asc_nulls_last(), F.when(number.isNull(), padded).asc_nulls_last()]


def expanded(names: list[str], shortcuts: dict[str, list[str]]) -> list[str]:
    """Names with shortcuts, in any case, replaced by what they stand for, which may be shortcuts again; each once."""
    by = {k.lower(): v for k, v in shortcuts.items()}
    out: list[str] = []

    def add(name: str, within: tuple[str, ...]) -> None:
        if name.lower() in within:
            raise ValueError(f"{name} stands for itself")
        if name.lower() in by:
            for x in by[name.lower()]:
                add(x, (*within, name.lower()))
        elif name not in out:
            out.append(name)

    for n in names:
        add(n, ())
    return out


def shown(df: DataFrame, wanted: list[str], prints: dict[str, Callable[[Column], Column]], plain: bool = False) -> DataFrame:
    """Wanted columns as they are printed; as plain values where all are wanted so, or where a name ends in #."""
    out = []
    for name in wanted:
        own = name.rstrip("#")
        out.append(F.col(own).alias(name) if plain or name.endswith("#") or own not in prints else prints[own](F.col(own)).alias(name))
    return df.select(*out)


def known_at(df: DataFrame, level: str, most: int) -> DataFrame:
    """Rows of at most a level: 0 for what is known, 1 and 2 for what is less so; an unstated level is 0."""
    return df.where(F.coalesce(F.col(level), F.lit(0)) <= most)


def mapped_values(df: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    """A change of text applied to every text of a row, those in lists, structs and maps' values too."""

    def of(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return change(c)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: of(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda _, x: of(x, kind.valueType))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[of(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        return c

    return df.select(*[of(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def composite(require: list[Column], desire: list[Column], inhibit: list[Column], value: Column) -> Column:
    """A value that needs all of some inputs, may use others, and is not made where one of a third kind is given."""
    ok = F.lit(True)
    for c in require:
        ok = ok & c.isNotNull()
    for c in inhibit:
        ok = ok & c.isNull()
    given = F.lit(True) if not desire or require else F.coalesce(*desire).isNotNull()
    return F.when(ok & given, value)


def tag_order(mode: str) -> list[Column]:
    """Sort keys of rows of (group, tag, description, file_order, asked): as asked for, as in the file, by name, by
    description, or by group and then as in the file."""
    keys = {"input": ["asked", "file_order"], "file": ["file_order"], "tag": ["tag", "file_order"], "description": ["description", "file_order"], "group": ["group", "file_order"]}
    return [F.lower(F.col(k)).asc() if k in ("tag", "description") else F.col(k).asc() for k in keys[mode]]
