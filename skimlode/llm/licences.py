"""License scans by diagonal voting, in DataFrame functions only.

Every rolling word k-gram of a text is joined by its hash to the places where license templates have it, and verified
word by word. Each hit votes for the place at which the template would begin (its diagonal). Votes are bits of a mask, one
for each k-gram of a template's section, so repeated votes count once and masks are added up by OR before and after the
shuffle. Masks of neighbouring diagonals are united: words left out of a copy, or put into it, shift what follows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of a k-gram, k-grams of a section (bits of a mask), words by which a copy may be shifted, and the least share of a section.
GRAM, SECTION, SLACK, LEAST = 3, 62, 4, 0.8
#: k-grams of all templates together, at most: they are broadcast, some 100 bytes each.
MOST_GRAMS = 1 << 20
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """exact: the words count only where all stand consecutively; else `LEAST` of a section's k-grams near one diagonal."""

    label: str
    text: str
    exact: bool = False


#: Phrases of the contract, and sentences of public licenses and their notices.
TEMPLATES = (
    Template("mit", "under the mit license", exact=True),
    Template("apache-2", "apache license version 2", exact=True),
    Template("cc-by-nc", "cc by nc", exact=True),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    Template("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("gpl-3", "licensed under the GNU General Public License, version 3"),
    Template("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template("cc0", "has waived all copyright and related or neighboring rights to this work"),
)


def words_of(text: Column) -> Column:
    """Words of a text, A-Z in lower case; none of a null text."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), "")


def _grams(rows: DataFrame, keys: list[str], gram: int) -> DataFrame:
    """keys, pos, w0.. of each place of column `words`, and a row after the last word with w0 null: its pos is their number."""
    ended = F.concat("words", F.array(F.lit(None).cast("string")))
    shifted = [ended, *[F.slice("words", k + 1, F.size("words")) for k in range(1, gram)]]
    placed = rows.select(*keys, F.posexplode(F.arrays_zip(*[c.alias(f"w{k}") for k, c in enumerate(shifted)])).alias("pos", "gram"))
    named = [F.col("gram").getField(f).alias(f"w{k}") for k, f in enumerate(placed.schema["gram"].dataType.names)]
    return placed.select(*keys, F.col("pos").cast("long").alias("pos"), *named)


def template_grams(spark: SparkSession, templates: tuple[Template, ...], gram: int = GRAM) -> DataFrame:
    """section, label, exact, size (the section's k-grams), bit, hash, t0..: each k-gram of each template.

    Templates are cut into sections of SECTION k-grams. Those with fewer words than a k-gram, and exact ones of more than one section, are errors.
    """
    listed = [F.struct(F.lit(k).alias("template"), F.lit(t.label).alias("label"), F.lit(t.exact).alias("exact"), F.lit(t.text).alias("text")) for k, t in enumerate(templates)]
    rows = spark.range(1).select(F.inline(F.array(*listed))).withColumn("words", words_of(F.col("text")))
    sizes = rows.select(F.size("words").alias("n"), "exact", "text").collect()  # a row for each template
    for r in sizes:
        if r.n < gram or r.exact and r.n - gram + 1 > SECTION:
            raise ValueError(f"a template of {r.n} words{', to be matched exactly' if r.exact else ''}: {r.text[:60]!r}")
    if sum(r.n - gram + 1 for r in sizes) > MOST_GRAMS:
        raise ValueError(f"templates of more than {MOST_GRAMS} k-grams")
    placed = _grams(rows.select("template", "label", "exact", F.size("words").alias("n"), "words"), ["template", "label", "exact", "n"], gram).where(f"w{gram - 1} IS NOT NULL")
    own = [F.col(f"w{k}").alias(f"t{k}") for k in range(gram)]
    section, whole = F.floor(F.col("pos") / SECTION), F.col("n") - (gram - 1)
    size = F.least(F.lit(SECTION), whole - section * SECTION).cast("int")
    return placed.select((F.col("template") * 65_536 + section).cast("long").alias("section"), "label", "exact", size.alias("size"), (F.col("pos") % SECTION).cast("int").alias("bit"), F.xxhash64(*[f"w{k}" for k in range(gram)]).alias("hash"), *own)


def diagonals(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, gram: int = GRAM, slack: int = SLACK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest, bytes (which together name a row), section, label, exact, size, start, mask, near, n_words, copies.

    A row for each diagonal of a text and a template's section that has votes: `start` is the word at which the section
    would begin, mask has the bits of verified k-grams, near those of the diagonals up to `slack` words further too. And
    a row for each text with section null: its number of words, and how many rows are equal to it.

    Texts are read once, and nothing of a text is shuffled but one row and its votes: masks are united in tasks first.
    A text's diagonals of one section are sorted in one task; there are no more than it has words.
    """
    keys = ["id", "digest", "bytes"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"), F.octet_length(text).alias("bytes"), words_of(F.col(text_col)).alias("words"))
    hits = _grams(rows, keys, gram).withColumn("hash", F.xxhash64(*[f"w{k}" for k in range(gram)]))
    known = F.broadcast(template_grams(docs.sparkSession, templates, gram).withColumnRenamed("hash", "their"))
    same = F.col("hash") == F.col("their")
    for k in range(gram):
        same = same & (F.col(f"w{k}") == F.col(f"t{k}"))
    votes = hits.join(known, same, "left").where("w0 IS NULL OR section IS NOT NULL")
    voted = F.col("section").isNotNull()
    start = F.when(voted, F.col("pos") - F.col("bit"))
    masks = votes.groupBy(*keys, "section", start.alias("start")).agg(
        F.first("label").alias("label"), F.first("exact").alias("exact"), F.first("size").alias("size"),
        F.bit_or(F.when(voted, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit")))).alias("mask"),
        F.max(F.when(~voted, F.col("pos"))).alias("n_words"), F.sum(F.when(~voted, 1)).alias("copies"),
    )
    beside = Window.partitionBy(*keys, "section").orderBy("start").rangeBetween(0, slack)
    return masks.withColumn("near", F.bit_or("mask").over(beside))


def _share() -> Column:
    return F.bit_count("near") / F.col("size")


def _found(least: float) -> Column:
    """Of a diagonal: whether its section is there."""
    return F.when(F.col("exact"), F.bit_count("mask") == F.col("size")).otherwise(_share() >= least)


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, least: float = LEAST, gram: int = GRAM, slack: int = SLACK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row of docs, under its own id's name.

    base: places of exact templates; first_word and last_word are the smallest and largest word at which one begins (null
    without any). labels: those of exact templates and of templates of which a section is there; distinct, sorted, joined
    by commas (empty without any). score: the largest share of a section's k-grams near one diagonal.
    Null and empty texts have no words and no labels. Repeated rows, null ids and ids with several texts are judged row by
    row; an empty table gives no rows; columns of docs other than the two don't matter.
    """
    found = _found(least)
    exact = F.col("exact") & found
    joined = lambda labels: F.array_join(F.sort_array(labels), ",")
    out = diagonals(docs, templates, gram, slack, id_col, text_col).groupBy("id", "digest", "bytes").agg(
        F.max("n_words").alias("n_words"), F.count_if(exact).alias("n_base"), F.min(F.when(exact, F.col("start"))).alias("first_word"), F.max(F.when(exact, F.col("start"))).alias("last_word"),
        joined(F.collect_set(F.when(exact, F.col("label")))).alias("base_labels"), joined(F.collect_set(F.when(found, F.col("label")))).alias("labels"),
        F.coalesce(F.max(_share()), F.lit(0.0)).alias("score"), F.max("copies").alias("copies"),
    )
    each = out.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return each.drop("copy")


def spans(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, least: float = LEAST, gram: int = GRAM, slack: int = SLACK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, label, start, end (words, end not included), share: each stretch of a text where a template's section is.

    Accepted diagonals no further apart than `slack` are one stretch. Equal rows with equal ids are reported once.
    """
    ok = diagonals(docs, templates, gram, slack, id_col, text_col).where(F.col("section").isNotNull() & _found(least))
    keys = ["id", "digest", "bytes", "section"]
    ahead = F.lag("start").over(Window.partitionBy(*keys).orderBy("start"))
    apart = ok.withColumn("opens", F.when(ahead.isNull() | (F.col("start") - ahead > F.when(F.col("exact"), 0).otherwise(slack)), 1).otherwise(0))
    islands = apart.withColumn("island", F.sum("opens").over(Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, 0)))
    share = F.when(F.col("exact"), F.lit(1.0)).otherwise(_share())
    return islands.groupBy(*keys, "label", "size", "island").agg(F.greatest(F.min("start"), F.lit(0).cast("long")).alias("start"), (F.max("start") + F.col("size") + gram - 1).alias("end"), F.max(share).alias("share")).select(F.col("id").alias(id_col), "label", "start", "end", "share")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    values = ", ".join(f"({k}, '{t.label}', {t.exact}, '{t.text}')" for k, t in enumerate(TEMPLATES))
    words = lambda text: f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    grams = lambda keys, rows: f"SELECT {keys}, i, w[i + 1] AS a, w[i + 2] AS b, w[i + 3] AS c FROM (SELECT *, unnest(range(0, len(w) - 2)) AS i FROM {rows})"
    return f"""WITH d AS (SELECT doc_id, {words("text")} AS w FROM documents),
    t AS (SELECT t, label, exact, {words("x")} AS w FROM (VALUES {values}) v(t, label, exact, x)),
    tg AS (SELECT *, i // {SECTION} AS sec, i % {SECTION} AS bit, least({SECTION}, n - i // {SECTION} * {SECTION}) AS size FROM ({grams("t, label, exact, len(w) - 2 AS n", "t")})),
    v AS (SELECT doc_id, t, sec, label, exact, size, g.i - bit AS start, bit_or(1::BIGINT << CAST(bit AS INTEGER)) AS mask FROM ({grams("doc_id", "d")}) g JOIN tg USING (a, b, c) GROUP BY ALL),
    s AS (SELECT *, bit_count(mask) = size AS whole, bit_count(bit_or(mask) OVER (PARTITION BY doc_id, t, sec ORDER BY start RANGE BETWEEN CURRENT ROW AND {SLACK} FOLLOWING)) / size::DOUBLE AS share FROM v),
    f AS (SELECT *, exact AND whole AS base, CASE WHEN exact THEN whole ELSE share >= {LEAST} END AS ok FROM s)
    SELECT d.doc_id, any_value(CAST(len(d.w) AS BIGINT)) AS n_words, coalesce(count_if(base), 0)::BIGINT AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (ok)), ','), '') AS labels, coalesce(max(share), 0.0)::DOUBLE AS score
    FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id"""


QUERIES = {"op13_license_scan": op13_license_scan}
ORACLES = {"op13_license_scan": _sql()}
