"""Text functions as Columns: escaping, padding, validity, lists, names and paths."""

import codecs

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def html_escaped(text: Column) -> Column:
    return _replaced(text, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")])


def xml_escaped(text: Column) -> Column:
    return _replaced(text, [("&", "&amp;"), (">", "&gt;"), ("<", "&lt;"), ('"', "&quot;"), ("'", "&#39;")])


def xml_unescaped(text: Column) -> Column:
    """The five named entities; `&amp;` last, so that it makes no new ones."""
    return _replaced(text, [("&gt;", ">"), ("&lt;", "<"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")])


def newlines_escaped(text: Column) -> Column:
    return _replaced(text, [("\r", "\\r"), ("\n", "\\n")])


def unquoted(text: Column) -> Column:
    """What lies between the first two double quotes, or the text if there are none."""
    return F.when(F.contains(text, F.lit('"')), F.element_at(F.split(text, '"'), 2)).otherwise(text)


def zero_padded(number: Column, width: int) -> Column:
    sign = F.when(number < 0, F.lit("-")).otherwise(F.lit(""))
    digits = F.abs(number).cast("string")
    return F.concat(sign, F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits))


def until_nul(text: Column) -> Column:
    return F.substring_index(text, "\0", 1)


def is_float(text: Column) -> Column:
    return text.rlike(r"^[+-]?(?=\d|\.\d)\d*(\.\d*)?([Ee][+-]?\d+)?$")


def is_int(text: Column) -> Column:
    return text.rlike(r"^[+-]?\d+$")


def is_hex(text: Column) -> Column:
    return text.rlike(r"^(0x)?[0-9a-fA-F]+$")


def is_rational(text: Column) -> Column:
    return text.rlike(r"^[-+]?\d+/\d+$")


def first_number(text: Column) -> Column:
    """The first number in a text as a double, else null."""
    found = F.regexp_extract(text, r"([+-]?(?:\d+\.?\d*|\.\d+)(?:[Ee][+-]?\d+)?)", 1)
    return F.when(found != "", found.cast("double"))


def extension(path: Column) -> Column:
    """What follows the last dot of a path's last part, in lower case; empty without one."""
    return F.lower(F.regexp_extract(path, r"\.([^./?#]+)(?:[?#].*)?$", 1))


def path_parts(path: Column) -> dict[str, Column]:
    """Directory (with its slash), name without extension, extension."""
    return {
        "directory": F.regexp_extract(path, r"^(.*/)", 1),
        "name": F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1),
        "extension": F.regexp_extract(path, r"\.([^./]*)$", 1),
    }


def is_utf8(data: Column) -> Column:
    return F.is_valid_utf8(data)


def letters_of(number: Column) -> Column:
    """a to z, then aa and so on, from 0, for any long."""
    one = lambda n: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (n % 26 + 1).cast("int"), F.lit(1))
    start = F.struct(number.cast("long").alias("n"), F.lit("").alias("out"))

    def step(s: Column, _: Column) -> Column:
        more = s["n"] >= 0
        return F.struct(F.when(more, F.floor(s["n"] / 26) - 1).otherwise(s["n"]).cast("long").alias("n"), F.when(more, F.concat(one(s["n"]), s["out"])).otherwise(s["out"]).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step)["out"]


def entities_unescaped(text: Column) -> Column:
    """Numeric entities, decimal or hexadecimal, as their characters; one beyond the last code point, or of half a pair,
    stays as it is."""
    form = r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"

    def character(entity: Column) -> Column:
        inner = F.regexp_extract(entity, r"^&#[xX]?([0-9a-fA-F]+);$", 1)
        code = F.when(entity.rlike("^&#[xX]"), F.conv(inner, 16, 10)).otherwise(inner).cast("long")
        ok = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(F.when(ok, code).otherwise(63)), 8, "0")), "UTF-32")).otherwise(entity)

    between, found = F.split(text, form, -1), F.regexp_extract_all(text, F.lit(form), F.lit(0))
    return F.concat(F.array_join(F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda a, b: F.concat(a, character(b))), ""), F.element_at(between, -1))


def joined_list(values: Column) -> Column:
    """A list as one text between `; `: an item with a semicolon, a quote or space at an end is quoted, its quotes doubled."""
    item = lambda x: F.when(x.rlike(r'[;"]|^\s|\s$') | (x == ""), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    return F.array_join(F.transform(values, item), "; ")


def split_list(text: Column) -> Column:
    """The items of joined_list()."""
    form = r'\s*("(?:[^"]|"")*"|[^;]*?)\s*(?:;|$)'
    bare = lambda x: F.when(x.startswith('"') & x.endswith('"') & (F.length(x) > 1), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)
    found = F.regexp_extract_all(text, F.lit(form), F.lit(1))
    # The end of a text that does not end in a semicolon matches once more, with nothing.
    return F.transform(F.when(F.size(found) > 1, F.slice(found, F.lit(1), F.size(found) - 1)).otherwise(found), bare)


# Colours of a sensor's cells by their numbers.
CELLS = ["Red", "Green", "Blue", "Cyan", "Magenta", "Yellow", "White"]


def cell_pattern(text: Column) -> Column:
    """`columns rows c c c ...` as [Red,Green][Green,Blue]; null where the numbers do not fit."""
    n = F.transform(F.split(F.trim(text), r"\s+"), lambda x: x.try_cast("int"))
    wide, high = F.try_element_at(n, F.lit(1)), F.try_element_at(n, F.lit(2))
    fits = (wide > 0) & (high > 0) & (F.size(n) == wide * high + 2) & F.forall(F.slice(n, 3, F.size(n)), lambda x: x.between(0, len(CELLS) - 1))
    names = F.transform(F.slice(n, F.lit(3), F.size(n)), lambda x: F.element_at(F.array(*map(F.lit, CELLS)), x + 1))
    row = lambda k: F.concat(F.lit("["), F.array_join(F.slice(names, k * wide + 1, wide), ","), F.lit("]"))
    return F.when(F.coalesce(fits, F.lit(False)), F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(high, F.lit(1)) - 1), row), ""))


def charset_decoded(data: Column, charset: str) -> Column:
    """Bytes in a named character set as text, bytes that fit nothing replaced. Sets that the JVM's functions know stay
    there; others go through Python's codecs, a batch at a time."""
    if charset.upper() in {"US-ASCII", "ISO-8859-1", "UTF-8", "UTF-16BE", "UTF-16LE", "UTF-16", "UTF-32"}:
        return F.decode(data, charset)
    codecs.lookup(charset)

    @F.pandas_udf("string")
    def decoded(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else bytes(x).decode(charset, "replace"))

    return decoded(data)


def quoted_csv(text: Column) -> Column:
    """A CSV field: quoted where it holds a comma, a quote, a line break, or space at an end."""
    needs = text.rlike(r'[,"\r\n]|^\s|\s$')
    return F.when(needs, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def json_value(text: Column) -> Column:
    """A JSON scalar: numbers and booleans bare, all else quoted and escaped."""
    bare = text.rlike(r"^-?(\d|[1-9]\d{1,14})(\.\d{1,16})?([eE][-+]?\d{1,3})?$") | F.lower(text).isin("true", "false")
    escaped = _replaced(text, [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")])
    return F.when(bare, F.lower(text)).otherwise(F.concat(F.lit('"'), escaped, F.lit('"')))


def spoken_name(name: Column) -> Column:
    """A name's words: split where case or digits begin a new one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(name, F.lit("_"), F.lit(" ")), r"([a-z])([A-Z\d])", "$1 $2"), r"([A-Z])([A-Z][a-z])", "$1 $2"))


def restored(short: Column, long: Column, size: int) -> Column:
    """The long text where the short one is its beginning, cut at `size`; else the short one."""
    return F.when((F.length(short) == size) & long.startswith(short), long).otherwise(short)
