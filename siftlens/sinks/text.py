"""Lines from rows: templates with a head, a body for each row and a tail; tables; drawings."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Templates of track files.
GPX = (
    ['<?xml version="1.0" encoding="utf-8"?>', '<gpx version="1.0" xmlns="http://www.topografix.com/GPX/1/0">', "<trk>", "<trkseg>"],
    ['<trkpt lat="$lat" lon="$lon">', "<ele>$alt</ele>", "<time>$time</time>", "</trkpt>"],
    ["</trkseg>", "</trk>", "</gpx>"],
)


def filled(template: str, columns: list[str], otherwise: str | None = None) -> Column:
    """A line with each $name or ${name} replaced by the column's text. A line that names a missing or null value is null,
    or has `otherwise` in its place."""
    parts, at = [], 0
    for m in re.finditer(r"\$(?:\{(\w+)\}|(\w+))", template):
        parts.append(F.lit(template[at : m.start()]))
        name = m[1] or m[2]
        value = F.col(name).cast("string") if name in columns else F.lit(None).cast("string")
        parts.append(F.coalesce(value, F.lit(otherwise)) if otherwise is not None else value)
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def printed(df: DataFrame, head: list[str], body: list[str], tail: list[str], order: list[str], otherwise: str | None = None) -> DataFrame:
    """Lines (section, order columns, line_no, line): the head, the body of each row, the tail. Lines that name missing
    values are left out. To be sorted by section, order columns and line_no."""
    spark = df.sparkSession
    each = F.array(*[F.struct(F.lit(k).alias("line_no"), filled(t, df.columns, otherwise).alias("line")) for k, t in enumerate(body)])
    rows = df.select(F.lit(1).alias("section"), *order, F.inline(each)).where("line is not null")
    fixed = spark.createDataFrame([(0, k, x) for k, x in enumerate(head)] + [(2, k, x) for k, x in enumerate(tail)], "section int, line_no int, line string")
    return rows.unionByName(fixed, allowMissingColumns=True)


def svg_path(points: Column) -> Column:
    """A path through points (array of x, y): M at the start, H and V where only one coordinate changes, else L."""
    n = F.size(points)

    def step(i: Column) -> Column:
        a, b = F.element_at(points, i), F.element_at(points, i + 1)
        x, y = b["x"].cast("string"), b["y"].cast("string")
        return F.when(a["y"] == b["y"], F.concat(F.lit("H"), x)).when(a["x"] == b["x"], F.concat(F.lit("V"), y)).otherwise(F.concat(F.lit("L"), x, F.lit(" "), y))

    first = F.element_at(points, 1)
    start = F.concat(F.lit("M"), first["x"].cast("string"), F.lit(" "), first["y"].cast("string"))
    steps = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), step)).otherwise(F.array().cast("array<string>"))
    return F.when(n > 0, F.concat_ws(" ", F.concat(F.array(start), steps)))


def json_record(columns: dict[str, Column]) -> Column:
    """A JSON object of values as text: numbers and booleans bare, nulls left out, names in the given order."""
    from siftlens.functions.text import json_value

    parts = [F.when(c.isNotNull(), F.concat(F.lit(f'"{name}": '), json_value(c.cast("string")))) for name, c in columns.items()]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def rdf_record(about: Column, groups: dict[str, dict[str, Column]]) -> Column:
    """An RDF description with a namespace for each group; null values are left out."""
    from siftlens.functions.text import xml_escaped

    parts = [F.when(c.isNotNull(), F.concat(F.lit(f"<{g}:{name}>"), xml_escaped(c.cast("string")), F.lit(f"</{g}:{name}>"))) for g, columns in groups.items() for name, c in columns.items()]
    return F.concat(F.lit("<rdf:Description rdf:about='"), xml_escaped(about), F.lit("'>"), F.concat_ws("", *parts), F.lit("</rdf:Description>"))


def csv_line(columns: list[Column]) -> Column:
    """A CSV line; null fields are empty."""
    from siftlens.functions.text import quoted_csv

    return F.concat_ws(",", *[F.coalesce(quoted_csv(c.cast("string")), F.lit("")) for c in columns])


def csv_export(df: DataFrame, key: str, name: str, value: str, most: int = 10_000) -> tuple[str, DataFrame]:
    """Long rows (key, name, value) as CSV: the header line over the union of all names, by name, and a line for each key
    with an empty field where it lacks a name. A header of more than `most` names is an error."""
    names = [r[0] for r in df.select(name).distinct().orderBy(name).limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} columns")
    wide = df.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(name, value))).alias("values"))
    fields = [F.try_element_at("values", F.lit(n)) for n in names]
    return ",".join([key, *names]), wide.select(key, csv_line([F.col(key), *fields]).alias("line"))


def laid_out(layout: str, group: Column, tag: Column, description: Column, value: Column) -> Column:
    """A line of one value: `plain`, `group` (its group in front), `short` and `very_short` (by tag), `long` (padded to 32
    characters), `tab`, `table` (a row of HTML), `args` and `values`."""
    from siftlens.functions.text import html_escaped

    tabbed = lambda *x: F.concat_ws("\t", *x)
    cell = lambda x: F.concat(F.lit("<td>"), html_escaped(x), F.lit("</td>"))
    forms = {
        "plain": F.concat(description, F.lit(": "), value),
        "group": F.concat(F.lit("["), group, F.lit("] "), F.rpad(description, 32, " "), F.lit(": "), value),
        "short": F.concat(tag, F.lit(": "), value),
        "very_short": F.concat_ws(" ", tag, value),
        "long": F.concat(F.rpad(description, 32, " "), F.lit(": "), value),
        "tab": tabbed(description, value),
        "table": F.concat(F.lit("<tr>"), cell(description), cell(value), F.lit("</tr>")),
        "args": F.concat(F.lit("-"), group, F.lit(":"), tag, F.lit("="), value),
        "values": value,
    }
    return forms[layout]


def output_name(form: str, path: Column, tag: Column | None = None) -> Column:
    """A file's name from a form with %d (directory and slash), %f (name), %e (extension), %t (tag); a number after the %
    takes so many characters, or with a minus so many from the end; a capital U or L after that changes case."""
    from siftlens.functions.text import path_parts

    parts = path_parts(path)
    source = {"d": parts["directory"], "f": parts["name"], "e": parts["extension"], "t": F.lit("") if tag is None else tag}
    out, at = [], 0
    for m in re.finditer(r"%(-?)(\d*)([UL]?)([dfet%])", form):
        out.append(F.lit(form[at : m.start()]))
        at = m.end()
        if m[4] == "%":
            out.append(F.lit("%"))
            continue
        x = source[m[4]]
        if m[2]:
            x = F.right(x, F.lit(int(m[2]))) if m[1] else F.left(x, F.lit(int(m[2])))
        out.append(F.upper(x) if m[3] == "U" else F.lower(x) if m[3] == "L" else x)
    return F.concat(*out, F.lit(form[at:]))


def counted_names(df: DataFrame, name: str, *order: str, to: str = "target") -> DataFrame:
    """Names made unique: the second and later rows of a name get `_1`, `_2` before the extension."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(name).orderBy(*order)) - 1
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^./]*)?$", 2)
    return df.withColumn(to, F.when(n == 0, F.col(name)).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), ext)))


def json_nested(columns: dict[str, Column]) -> Column:
    """A JSON object of values that may be lists and structs; binary values as `base64:` texts, nulls left out."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in columns.items()]))


def base64_text(data: Column) -> Column:
    return F.concat(F.lit("base64:"), F.replace(F.base64(data), F.lit("\r\n"), F.lit("")))


def write_each(df: DataFrame, by: str, line: str, path: str, append: bool = False) -> None:
    """Lines written as text below a folder for each value of a column; no folder for a value without lines."""
    df.where(F.col(line).isNotNull()).select(by, line).write.mode("append" if append else "overwrite").partitionBy(by).text(path)
