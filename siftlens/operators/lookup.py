"""Joins that look something up: labels, reverse labels, bits, list places, overlays. Dimensions are left to the planner:
it broadcasts those that are small and shuffles the rest."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_of(code: Column, labels: dict, hexadecimal: bool = False) -> Column:
    """The label of a code, else `Unknown (code)`; for a small fixed dictionary."""
    out = F.lit(None).cast("string")
    for key, text in labels.items():
        out = F.when(code == F.lit(key), F.lit(text)).otherwise(out)
    shown = F.concat(F.lit("0x"), F.lower(F.hex(code))) if hexadecimal else code.cast("string")
    return F.when(code.isNotNull(), F.coalesce(out, F.concat(F.lit("Unknown ("), shown, F.lit(")"))))


def join_labels(df: DataFrame, labels: DataFrame, code: str, label: str = "label") -> DataFrame:
    """Rows with the label of their code (labels: code, label), else `Unknown (code)`."""
    named = df.join(labels.select(F.col("code").alias(code), F.col("label").alias(label)), code, "left")
    unknown = F.concat(F.lit("Unknown ("), F.col(code).cast("string"), F.lit(")"))
    return named.withColumn(label, F.when(F.col(code).isNotNull(), F.coalesce(label, unknown)))


def codes_of(wanted: DataFrame, labels: DataFrame) -> DataFrame:
    """For each wanted text the code whose label fits: exactly, else in any case, else as a prefix, else anywhere. The
    best kind of fit counts; several codes of that kind make the text ambiguous, and its code null. labels: code, label;
    a small dictionary, whose size bounds the pairs looked at."""
    fit = (
        F.when(F.col("label") == F.col("wanted"), 0)
        .when(F.lower("label") == F.lower("wanted"), 1)
        .when(F.lower("label").startswith(F.lower("wanted")), 2)
        .when(F.contains(F.lower("label"), F.lower("wanted")), 3)
    )
    pairs = wanted.join(labels, F.contains(F.lower("label"), F.lower("wanted")), "left").withColumn("fit", fit)
    best = pairs.withColumn("best", F.min("fit").over(Window.partitionBy("wanted"))).where(F.col("fit").eqNullSafe(F.col("best")))
    n = F.count("code")
    return best.groupBy("wanted").agg(F.when(n == 1, F.min("code")).alias("code"), n.alias("n_fits"))


def bit_labels(bits: Column, labels: dict[int, str], width: int = 8) -> Column:
    """Labels of the bits that are set, in order; `[n]` for one without a label, `(none)` where none is set."""
    each = [F.when(F.shiftright(bits, k).bitwiseAND(F.lit(1)) == 1, F.lit(labels.get(k, f"[{k}]"))) for k in range(width)]
    return F.when(bits.isNotNull(), F.when(bits == 0, F.lit("(none)")).otherwise(F.concat_ws(", ", *each)))


def overlay(df: DataFrame, imported: DataFrame, key: str, columns: list[str], any_key: str = "*") -> DataFrame:
    """Rows with imported values laid over them: those of the row's key, else those of the row for any key, else its own.
    imported holds text keys, one row each; of several rows for
    any key each least value counts."""
    exact = imported.where(F.col(key) != any_key).select(F.col(key).alias("overlay_key"), *[F.col(c).alias(f"exact_{c}") for c in columns])
    every = imported.where(F.col(key) == any_key).agg(*[F.min(c).alias(f"every_{c}") for c in columns])
    out = df.join(exact, df[key].cast("string") == F.col("overlay_key"), "left").join(F.broadcast(every), F.lit(True), "left")
    return out.select(*[F.coalesce(f"exact_{c}", f"every_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns])


def replace_if(column: Column, old: Column, new: Column) -> Column:
    """A value is replaced only where it is the old one."""
    return F.when(column.eqNullSafe(old), new).otherwise(column)


def without(values: Column, gone: Column) -> Column:
    """A list without all items equal to one; repeated others stay."""
    return F.filter(values, lambda x: ~x.eqNullSafe(gone))


def attached(df: DataFrame, other: DataFrame, on: dict[str, str], columns: dict[str, str]) -> DataFrame:
    """Rows with columns (new name: name in the other table) of the row of another table that their keys name (own column:
    other's column); null where there is none. The other table has one row a key."""
    side = other.select(*[F.col(c).alias(f"other_{k}") for k, c in enumerate(on.values())], *[F.col(c).alias(n) for n, c in columns.items()])
    same = [df[own] == F.col(f"other_{k}") for k, own in enumerate(on)]
    return df.join(side, same, "left").select(*df.columns, *columns)


def copied(df: DataFrame, source: DataFrame, key: Column, source_key: str, columns: list[str]) -> DataFrame:
    """Rows with some columns copied from the row of a source table that an expression names. Values that the source lacks,
    or a source that is not there, leave a row's own."""
    side = source.select(F.col(source_key).alias("source_key"), *[F.col(c).alias(f"source_{c}") for c in columns])
    both = df.withColumn("wanted_key", key).join(side, F.col("wanted_key") == F.col("source_key"), "left")
    return both.select(*[F.coalesce(f"source_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns])


def first_existing(df: DataFrame, known: DataFrame, key: str, candidates: list[Column], name: str) -> DataFrame:
    """Rows with the first of some candidate keys that a table holds; null where it holds none."""
    keys = known.select(F.col(key).alias("known_key")).distinct()
    out, found = df, []
    for k, c in enumerate(candidates):
        out = out.withColumn(f"try_{k}", c).join(keys.select(F.col("known_key").alias(f"known_{k}")), F.col(f"try_{k}") == F.col(f"known_{k}"), "left")
        found.append(F.col(f"known_{k}"))
    return out.select(*df.columns, F.coalesce(*found).alias(name))


def localised(df: DataFrame, labels: DataFrame, tag: str, lang: str, base: str = "en", name: str = "description") -> DataFrame:
    """Rows with the description of their tag in a language, else in the base language, else the tag itself. labels: lang,
    tag, text."""
    side = lambda x, n: labels.where(F.col("lang") == x).select(F.col("tag").alias(f"{n}_tag"), F.col("text").alias(n))
    out = df.join(side(lang, "own_text"), F.col(tag) == F.col("own_text_tag"), "left").join(side(base, "base_text"), F.col(tag) == F.col("base_text_tag"), "left")
    return out.select(*df.columns, F.coalesce("own_text", "base_text", tag).alias(name))


def resolved(name: Column, aliases: dict[str, str], depth: int = 2) -> Column:
    """A name after its aliases, each of which may be one again."""
    pairs = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    for _ in range(depth):
        name = F.coalesce(F.try_element_at(pairs, name), name)
    return name


def reconciled(new: Column, old: Column, digest: Column, most: int) -> Column:
    """Of a value and its older, shorter form: the new one where the digest that was stored with it is still that of the
    old, or where none was; else, as the old one was changed since, the old one, or the new one if the old is only its
    beginning, cut at `most`."""
    from siftlens.functions.text import restored

    unchanged = digest.isNull() | (digest == F.md5(old.cast("binary")))
    return F.when(old.isNull() | (unchanged & new.isNotNull()), new).otherwise(F.when(new.isNull(), old).otherwise(restored(old, new, most)))
