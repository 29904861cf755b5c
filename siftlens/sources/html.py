"""The head of web pages, as Columns: title, language, charset, and all meta names with their contents."""

import html as entities

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_META = r"(?is)<meta\b([^>]*)>"


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def head(column: str) -> dict[str, Column]:
    page = F.col(column)
    top = F.regexp_extract(page, r"(?is)<head[^>]*>(.*?)</head>", 1)
    return {
        "head": top,
        "title": _found(top, r"(?is)<title[^>]*>(.*?)</title>"),
        "lang": _found(page, r'(?is)<html[^>]*\blang="([^"]*)"'),
        "charset": F.lower(_found(top, r'(?is)<meta[^>]*\bcharset="?([\w-]+)')),
    }


@F.pandas_udf(T.StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """Named and numbered entities resolved; Spark has no function for them."""
    return text.map(entities.unescape, na_action="ignore")


def head_list(column: str) -> Column:
    """The tags of a page's head in order, as structs of name and value. Names of `meta name` and `http-equiv` are in lower
    case. Pages without a head give the language at most."""
    h = head(column)
    first = F.array(*[F.struct(F.lit(n).alias("name"), h[n].alias("value")) for n in ("title", "lang", "charset")])
    attributes = F.regexp_extract_all(h["head"], F.lit(_META), F.lit(1))
    named = F.transform(attributes, lambda a: F.struct(
        F.lower(F.regexp_extract(a, r'(?i)\b(?:name|http-equiv)\s*=\s*["\']?([^"\'\s>]+)', 1)).alias("name"),
        F.regexp_extract(a, r'(?i)\bcontent\s*=\s*["\']([^"\']*)["\']', 1).alias("value")))
    return F.concat(F.filter(first, lambda x: x["value"].isNotNull()), F.filter(named, lambda x: x["name"] != ""))


def head_tags(pages: DataFrame, id_col: str, column: str) -> DataFrame:
    """A row for each tag of a page's head: id, name, value, place."""
    every = pages.select(id_col, F.posexplode(head_list(column)).alias("place", "tag"))
    return every.select(id_col, "tag.name", "tag.value", F.col("place").cast("long").alias("place"))


def head_wide(pages: DataFrame, id_col: str, column: str, names: dict[str, str]) -> DataFrame:
    """One row a page with a column for each wanted name (name in the head: column), the last of several by that name, for
    pages that have any. What belongs to one page is in one row from the start, so nothing is shuffled."""
    tags = pages.select(id_col, head_list(column).alias("tags"))
    last = lambda n: F.try_element_at(F.filter("tags", lambda x: x["name"] == n), F.lit(-1))["value"]
    wide = tags.select(id_col, *[last(n).alias(c) for n, c in sorted(names.items(), key=lambda x: x[1])])
    return wide.where(F.coalesce(*names.values()).isNotNull())
