"""License scans by diagonal voting, in DataFrame functions only.

All rolling word k-grams of a text are hashed and joined to the positions of template grams, a fixed small table that
is broadcast. A hit at word i of the text and word j of a template votes for the diagonal i - j. Votes are counted per
diagonal, neighbouring diagonals (a few words put in or left out) are merged, and a span counts when enough of its
template's grams are there word for word: all of a phrase, ``LEAST_SHARE`` of a longer text.

Every document also sends one mark of its own through the join, so documents without a hit stay in the result.

Words are lower-cased (A-Z) runs of digits, letters a-z and characters beyond ASCII. Null and empty texts have no words
and no label. Repeated rows each get a row; a null id is kept.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PHRASE_GRAM, TEXT_GRAM = 2, 4
NEIGHBOURS = 3
LEAST_SHARE = 0.5
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_MARK = -1

#: Phrases that must stand word for word, with their base label.
BASE_PHRASES = (
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
)
#: Further phrases, found word for word.
PHRASES = (
    ("all-rights-reserved", "all rights reserved"),
    ("bsd", "bsd license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "cc0 1 0 universal"),
    ("mpl", "mozilla public license"),
    ("public-domain", "released into the public domain"),
)
#: Opening passages of public license texts, found in part.
TEXTS = (
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
               "with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is "
               "distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the "
            "following disclaimer"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation either version"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction including without limitation "
            "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify "
                  "publish use compile sell or distribute this software"),
)


def words_of(text: Column) -> Column:
    """Lower-cased words of a text; an empty array for null."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate(F.coalesce(text, F.lit("")), capitals, capitals.lower())
    return F.array_remove(F.split(lowered, _BETWEEN), "")


def gram_hashes(words: Column, k: int) -> Column:
    """Hash of the k words from every word on; the last ones, which have fewer words, match no template."""
    return F.transform(words, lambda w, i: F.xxhash64(F.lit(k), w, *(F.get(words, i + j) for j in range(1, k))))


def templates(spark: SparkSession) -> DataFrame:
    """One row per template: number, label, whether it is a base phrase, gram length, words."""
    rows = [(label, text, base, PHRASE_GRAM) for base, group in ((True, BASE_PHRASES), (False, PHRASES))
            for label, text in group] + [(label, text, False, TEXT_GRAM) for label, text in TEXTS]
    values = ", ".join(f"({n}, '{label}', '{text}', {str(base).lower()}, {k})"
                       for n, (label, text, base, k) in enumerate(rows))
    return spark.sql(
        f"SELECT template, label, split(text, ' ') AS words, base, k FROM VALUES {values} AS t(template, label, text, base, k)"
    )


def template_grams(spark: SparkSession) -> DataFrame:
    """hash, template, offset and the gram's words, with the mark that every document hits; a fixed small table."""
    listed = templates(spark)
    parts = [
        listed.where(F.col("k") == k).select("template", "k", "words", F.posexplode(gram_hashes(F.col("words"), k)))
        .where(F.col("pos") <= F.size("words") - F.col("k"))
        .select(F.col("col").alias("hash"), "template", F.col("pos").alias("offset"),
                F.slice("words", F.col("pos") + 1, F.col("k")).alias("gram"))
        for k in (PHRASE_GRAM, TEXT_GRAM)
    ]
    mark = spark.sql(f"SELECT {_MARK}L AS hash, {_MARK} AS template, 0 AS offset, cast(array() AS array<string>) AS gram")
    return parts[0].unionByName(parts[1]).unionByName(mark)


def diagonals(docs: DataFrame) -> DataFrame:
    """Votes per (doc_id, text_key, n_words, template, diagonal): number, first and last word; and rows with the mark."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("words"))
    hashed = rows.select(
        "doc_id", "text_key", "words", F.size("words").alias("n_words"),
        F.concat(gram_hashes(F.col("words"), PHRASE_GRAM), gram_hashes(F.col("words"), TEXT_GRAM),
                 F.array(F.lit(_MARK).cast("long"))).alias("hashes"),
    )
    # The outer form, as the plain one adds a filter on the size of the array that computes all of it once more.
    rolled = hashed.select("doc_id", "text_key", "words", "n_words", F.posexplode_outer("hashes").alias("at", "hash"))
    place = F.when(F.col("template") == _MARK, 0).otherwise(F.col("at") % F.greatest("n_words", F.lit(1)))
    hits = (
        rolled.join(F.broadcast(template_grams(spark)), "hash").withColumn("i", place)
        .where((F.col("template") == _MARK) | (F.slice("words", F.col("i") + 1, F.size("gram")) == F.col("gram")))
    )
    keys = ["doc_id", "text_key", "n_words", "template"]
    voted = hits.groupBy(*keys, (F.col("i") - F.col("offset")).alias("diagonal"), "i").agg(F.count("*").alias("copies"))
    return voted.groupBy(*keys, "diagonal").agg(
        F.count("*").alias("votes"), F.min("i").alias("first"), F.max("i").alias("last"), F.max("copies").alias("copies"),
    )


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_words, copies, label, base, first_word, last_word and share of every verified span.

    A row with a null label stands for each document (``copies`` identical rows).
    """
    votes = diagonals(docs)
    listed = F.broadcast(templates(docs.sparkSession).select(
        "template", "label", "base", "k", (F.size("words") - F.col("k") + 1).alias("grams")))
    known = votes.join(listed, "template", "left")
    order = Window.partitionBy("doc_id", "text_key", "template").orderBy("diagonal")
    apart = (
        F.lag("diagonal").over(order).isNull()
        | (F.col("k") == PHRASE_GRAM)
        | (F.col("diagonal") - F.lag("diagonal").over(order) > NEIGHBOURS)
    )
    merged = known.withColumn("apart", apart).withColumn("run", F.sum(F.col("apart").cast("int")).over(order))
    runs = merged.groupBy("doc_id", "text_key", "n_words", "template", "label", "base", "k", "grams", "run").agg(
        F.sum("votes").alias("votes"), F.min("first").alias("first_word"), F.max("last").alias("last"),
        F.max("copies").alias("copies"),
    )
    share = F.when(F.col("label").isNotNull(), F.least(F.lit(1.0), F.col("votes") / F.col("grams")))
    needed = F.when(F.col("k") == PHRASE_GRAM, 1.0).otherwise(LEAST_SHARE)
    return runs.where(F.col("label").isNull() | (share >= needed)).select(
        "doc_id", "text_key", "n_words", "copies", "label", "base", "first_word",
        (F.col("last") + F.col("k") - 1).alias("last_word"), share.alias("share"),
    )


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of ``docs``."""
    base = F.col("base")

    def joined(condition: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(condition, F.col("label")))), ",")

    found = spans(docs).groupBy("doc_id", "text_key", "n_words").agg(
        F.max(F.when(F.col("label").isNull(), F.col("copies"))).alias("rows"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("label").isNotNull()).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    )
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels",
        "labels", "score",
    )


def scan_sql() -> str:
    """The scan as SQL over ``documents``, with the same templates."""
    rows = [(label, text, base, PHRASE_GRAM) for base, group in ((True, BASE_PHRASES), (False, PHRASES))
            for label, text in group] + [(label, text, False, TEXT_GRAM) for label, text in TEXTS]
    values = ", ".join(f"({n}, '{label}', '{text}', {str(base).lower()}, {k})"
                       for n, (label, text, base, k) in enumerate(rows))
    return f"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents
), given(template, label, text, base, k) AS (
  VALUES {values}
), listed AS (
  SELECT template, label, base, k, string_split(text, ' ') AS words FROM given
), offsets AS (
  SELECT *, unnest(range(0, len(words) - k + 1)) AS j FROM listed
), template_grams AS (
  SELECT template, k, j, words[j + 1:j + k] AS gram FROM offsets
), places AS (
  SELECT doc_id, words, unnest(range(0, len(words))) AS i FROM docs
), text_grams AS (
  SELECT doc_id, i, k, words[i + 1:i + k] AS gram FROM places, (VALUES ({PHRASE_GRAM}), ({TEXT_GRAM})) AS ks(k)
), votes AS (
  SELECT g.doc_id, t.template, g.i - t.j AS diagonal, count(*) AS votes, min(g.i) AS first_word
  FROM text_grams g JOIN template_grams t ON g.k = t.k AND g.gram = t.gram
  GROUP BY g.doc_id, t.template, g.i - t.j
), steps AS (
  SELECT v.*, l.label, l.base, l.k, len(l.words) - l.k + 1 AS grams,
         CASE WHEN l.k = {PHRASE_GRAM} THEN 1
              WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, v.template ORDER BY diagonal) <= {NEIGHBOURS}
              THEN 0 ELSE 1 END AS apart
  FROM votes v JOIN listed l USING (template)
), runs AS (
  SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS run FROM steps
), merged AS (
  SELECT doc_id, template, label, base, k, grams, run, sum(votes) AS votes, min(first_word) AS first_word
  FROM runs GROUP BY doc_id, template, label, base, k, grams, run
), spans AS (
  SELECT *, least(1.0::DOUBLE, votes::DOUBLE / grams) AS share FROM merged
), found AS (
  SELECT * FROM spans WHERE share >= CASE WHEN k = {PHRASE_GRAM} THEN 1.0 ELSE {LEAST_SHARE} END
), summed AS (
  SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(first_word) FILTER (WHERE base) AS first_word,
         max(first_word) FILTER (WHERE base) AS last_word,
         array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE base)), ',') AS base_labels,
         array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score
  FROM found GROUP BY doc_id
)
SELECT d.doc_id, len(d.words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM docs d LEFT JOIN summed s ON d.doc_id = s.doc_id
"""
