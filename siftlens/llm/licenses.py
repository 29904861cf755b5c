"""License scans by diagonal voting, in DataFrame operations.

Every text's words give rolling k-grams (k = 2), one row each; these are joined by hash to the places of the templates'
k-grams, and compared as words. A hit at word p of a text and word q of a template votes for the diagonal p - q: where
the template would begin. Votes are gathered for each diagonal as a set of template places (repeated rows vote once).
A phrase stands where a diagonal has all its votes; of a longer notice, neighbouring diagonals are merged, which
bridges words left out or put in, and the span is verified: the longest chain of votes that rises in the text and in the
notice alike must cover enough of the notice.

The templates are a table of checked size and are broadcast; votes are gathered within a document, so no key is shared
by many documents.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlens.llm.common import quoted, stored, table

# The phrases and labels of the contract.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Openings of public licenses' notices, as words.
NOTICES = [
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]

#: Diagonals this near are merged; the share of a notice's k-grams that a span must hold in order; k-grams of templates
#: that are broadcast, beyond which the join is left to the planner.
NEAR, COVER, MOST_GRAMS = 3, 0.6, 200_000

#: The template that every row of docs has a hit of.
OWN = -1

#: The Kelvin sign lower-cases to an ASCII letter, but only A-Z may; it becomes another letter first.
_KELVIN = "\u212a"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _low(text: Column) -> Column:
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(_KELVIN), F.lit("æ")))


def _templates(spark: SparkSession, templates: list[tuple[str, str]], phrases: int, k: int) -> tuple[DataFrame, int]:
    """One row for each k-gram: template, its label, place, how many it has, and the hash of its words; and the number of
    rows. The gram of k empty words is there as well, as template OWN."""
    rows = [(" " * (k - 1), OWN, None, False, 0, 1)]
    for n, (words, label) in enumerate(templates):
        split = words.split()
        grams = [" ".join(split[i : i + k]) for i in range(len(split) - k + 1)]
        rows += [(gram, n, label, n < phrases, place, len(grams)) for place, gram in enumerate(grams)]
    known = spark.createDataFrame(rows, "gram string, template int, label string, phrase boolean, place int, size int")
    split = F.split("gram", " ")
    return known.withColumn("hash", F.xxhash64(*[F.get(split, F.lit(i)) for i in range(k)])), len(rows)


def _chain(hits: Column) -> Column:
    """Of hits (at, place), the length of the longest chain in which both rise: what of a template stands in the text in
    its order. The array holds the smallest place that ends a chain of each length."""

    def step(tails: Column, place: Column) -> Column:
        n = F.size(F.filter(tails, lambda t: t < place))
        return F.concat(F.slice(tails, F.lit(1), n), F.array(place), F.slice(tails, n + 2, F.size(tails)))

    ordered = F.array_sort(F.transform(hits, lambda h: F.struct(h["at"].alias("at"), (-h["place"]).alias("back"))))
    return F.size(F.aggregate(F.transform(ordered, lambda h: -h["back"]), F.array().cast("array<int>"), step))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: list[tuple[str, str]] | None = None, notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """Each row of docs: its id, n_words, places (ordered structs of start and label: where phrases stand, in words
    from 0), notices (structs of label, start, end and cover: the best verified span for each label, in words, end
    exclusive) and score (1 with a phrase, else the best cover, else 0).

    Templates are lower-case words between spaces, of any number; k is 2, or 1 where some template has one word only. A
    null text counts as empty: no words, no places. Repeated rows each get the same result; rows that share an id are
    told apart by their texts. A null id is a value like others. Other columns are not read."""
    spark = docs.sparkSession
    phrases, notices = PHRASES if phrases is None else phrases, NOTICES if notices is None else notices
    k = min([2, *(len(words.split()) for words, _ in phrases + notices)])
    known, size = _templates(spark, phrases + notices, len(phrases), k)
    known = F.broadcast(known) if size <= MOST_GRAMS else known
    # k empty words stand before a text's own: their gram, which the templates' table holds too, is the row's own hit, so
    # that words are cut out once, for the votes and for the count.
    words = docs.select(
        quoted(id_col).alias("id"), F.coalesce(F.xxhash64(quoted(text_col)), F.lit(0)).alias("th"),
        F.concat(F.array(*[F.lit("")] * k), F.regexp_extract_all(_low(quoted(text_col)), F.lit(_WORD), F.lit(0))).alias("w"),
    )
    # The outer form, as for the plain one a filter would cut the words out once more.
    each = words.select("id", "th", "w", F.posexplode_outer("w").alias("at", "word"))
    parts = [F.col("word"), *[F.get("w", F.col("at") + i) for i in range(1, k)]]
    gram = F.concat(*[x for part in parts for x in (F.lit(" "), part)][1:])
    grams = each.select("id", "th", (F.size("w") - k).cast("long").alias("n_words"), (F.col("at") - k).alias("at"), gram.alias("gram"), F.xxhash64(*parts).alias("hash"))
    # Joined by the number alone; each begins with the other: they are equal, though not a key of the join.
    same = grams["gram"].startswith(known["gram"]) & known["gram"].startswith(grams["gram"])
    hits = grams.join(known, (grams["hash"] == known["hash"]) & same)
    hits = stored(hits.select("id", "th", "n_words", "at", "template", "label", "phrase", "place", "size"), "hits")  # small, and read thrice
    rows, hits = hits.where(F.col("template") == OWN), hits.where(F.col("template") != OWN)
    votes = hits.groupBy("id", "th", "template", "label", "phrase", "size", (F.col("at") - F.col("place")).alias("start")).agg(F.collect_set("place").alias("votes"))
    # A diagonal with all its votes has the phrase's words, which were compared, one after another.
    full = votes.where(F.col("phrase") & (F.size("votes") == F.col("size")))
    exact = full.groupBy("id", "th").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), "label"))).alias("places"))
    # Notices: sessions of near diagonals, whose votes are verified as one chain.
    order = Window.partitionBy("id", "th", "template").orderBy("start")
    some = votes.where(~F.col("phrase") & (F.size("votes") >= 2))
    some = some.withColumn("fresh", F.when(F.col("start") - F.lag("start").over(order) <= NEAR, 0).otherwise(1)).withColumn("group", F.sum("fresh").over(order))
    spots = F.transform("votes", lambda v: F.struct((F.col("start") + v).alias("at"), v.alias("place")))
    merged = some.groupBy("id", "th", "template", "label", "size", "group").agg(F.flatten(F.collect_list(spots)).alias("hits"))
    merged = merged.where(F.size(F.array_distinct(F.transform("hits", lambda h: h["place"]))) / F.col("size") >= COVER)
    merged = merged.withColumn("cover", _chain(F.col("hits")) / F.col("size")).where(F.col("cover") >= COVER)
    first, last = F.array_min(F.transform("hits", lambda h: h["at"])), F.array_max(F.transform("hits", lambda h: h["at"])) + k
    best = merged.groupBy("id", "th", "label").agg(F.max(F.struct("cover", (-first).alias("back"), last.alias("end"))).alias("top"))
    noted = best.groupBy("id", "th").agg(F.array_sort(F.collect_list(F.struct("label", (-F.col("top.back")).cast("long").alias("start"), F.col("top.end").cast("long").alias("end"), F.col("top.cover").alias("cover")))).alias("notices"))
    out = rows.select("id", "th", "n_words")
    for part in (exact, noted):
        part = part.withColumnsRenamed({"id": "part_id", "th": "part_th"})
        out = out.join(part, out["id"].eqNullSafe(part["part_id"]) & (out["th"] == part["part_th"]), "left").drop("part_id", "part_th")
    cover = F.coalesce(F.array_max(F.transform("notices", lambda x: x["cover"])), F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col), "n_words",
        F.coalesce("places", F.array().cast("array<struct<start:bigint,label:string>>")).alias("places"),
        F.coalesce("notices", F.array().cast("array<struct<label:string,start:bigint,end:bigint,cover:double>>")).alias("notices"),
        F.when(F.col("places").isNotNull(), F.lit(1.0)).otherwise(cover).alias("score"),
    )


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from the operator's."""
    starts = F.transform("places", lambda p: p["start"])
    base, noted = F.transform("places", lambda p: p["label"]), F.transform("notices", lambda p: p["label"])
    listed = lambda x: F.concat_ws(",", F.array_sort(F.array_distinct(x)))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(base).alias("base_labels"), listed(F.concat(base, noted)).alias("labels"), "score",
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan_licenses(table(spark, sf_dir, "documents")))
