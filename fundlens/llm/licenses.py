"""Operator 7, license scans by diagonal voting.

All rolling word grams of a document are hashed and joined to the grams of the templates. A hit
votes for a diagonal, its place in the document less its place in the template; an occurrence of a
template puts its votes on one diagonal, or on neighbouring ones where words were inserted or left
out. Diagonals that lie close together are merged, and a merged span counts if the template words
that it covers, compared word by word, make up enough of the template. Short phrases (grams of two
words) must be covered whole on a single diagonal, longer notices (grams of three) by half.

Scale: one scan, no text is shuffled. The templates are a fixed list, so their side of the join is
broadcast with a proven bound. Votes are counted map-side by (document, template, diagonal), and no
window holds more than one document's diagonals of one template. Built-in expressions only.

Defined cases: a null text is empty; rows equal in id and text get equal results, one row each; a
null id is allowed; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .text import NOT_ALNUM, grams, lower_ascii, pinned, total, whole, words

# The base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Wording of the licenses' own notices.
NOTICES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "licensed under the Creative Commons Attribution License",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain",
    ],
}
COVER = 0.5          # share of a notice's words that a span must cover
SLACK = 3            # diagonals this close are merged (notices)


def template_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def template_rows() -> list[tuple]:
    """(template, base, label, words, grams' size, slack, smallest number of covered words)."""
    out = [(p, True, label, template_words(p), 2, 0, len(template_words(p))) for p, label in PHRASES.items()]
    for label, notices in NOTICES.items():
        for i, text in enumerate(notices):
            ws = template_words(text)
            out.append((f"{label} notice {i}", False, label, ws, 3, SLACK, -(-len(ws) * COVER // 1)))
    return out


def template_grams(spark) -> DataFrame:
    """A row per gram: template, base, label, place, gram (words), hash."""
    rows = [(name, base, label, i, ws[i:i + k]) for name, base, label, ws, k, _, _ in template_rows() for i in range(len(ws) - k + 1)]
    df = spark.createDataFrame(rows, "template string, base boolean, label string, place int, gram array<string>")
    return df.withColumn("hash", F.xxhash64("gram"))


def votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, th, n_words) with a row for each template and diagonal that has hits, and one with null
    templates that counts the document's rows."""
    base = docs.select(F.col(f"`{id_col}`").alias("doc"), F.xxhash64(whole(F.col(f"`{text_col}`"))).alias("th"),
                       F.col(f"`{text_col}`").alias("t"))
    tokens = pinned(base, ["doc", "th"], ws=words(lower_ascii(whole("t")), NOT_ALNUM))
    # a null in front stands for the document itself; then the grams of three, then those of two
    tokens = pinned(tokens, ["doc", "th", "ws"], three=grams(F.col("ws"), 3), two=grams(F.col("ws"), 2))
    tokens = tokens.select("doc", "th", "ws", F.size("three").alias("n3"),
                           F.posexplode(F.concat(F.array(F.lit(None).cast("long")), "three", "two")).alias("i", "h"))
    hit = tokens.join(F.broadcast(template_grams(docs.sparkSession)), F.col("h") == F.col("hash"), "left")
    hit = hit.where("h IS NULL OR template IS NOT NULL")
    at = F.when(F.col("i") <= F.col("n3"), F.col("i") - 1).otherwise(F.col("i") - 1 - F.col("n3"))
    hit = hit.where(F.col("h").isNull() | (F.slice("ws", at + 1, F.size("gram")) == F.col("gram")))
    return (hit.select("doc", "th", F.size("ws").cast("long").alias("n_words"), "template", "base", "label", "place",
                       F.when(F.col("template").isNotNull(), at - F.col("place")).alias("diagonal"))
            .groupBy("doc", "th", "template", "diagonal")
            .agg(F.max("n_words").alias("n_words"), F.count(F.lit(1)).alias("n"), F.first("base").alias("base"),
                 F.first("label").alias("label"), F.collect_set("place").alias("places")))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Merged and verified spans: doc, th, n_words, template, base, label, first_word, cover (share
    of the template's words), ok; and the documents' own rows (template null, copies)."""
    info = F.create_map(*[x for name, _, _, ws, k, slack, least in template_rows() for x in (
        F.lit(name), F.struct(F.lit(len(ws)).alias("size"), F.lit(k).alias("k"), F.lit(slack).alias("slack"), F.lit(int(least)).alias("least")))])
    v = votes(docs, id_col, text_col).withColumn("info", info[F.col("template")])
    along = Window.partitionBy("doc", "th", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(along) > F.col("info.slack")).cast("int")
    v = v.withColumn("apart", F.coalesce(apart, F.lit(0)))
    v = v.withColumn("run", F.sum("apart").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    g = v.groupBy("doc", "th", "template", "run").agg(
        F.max("n_words").alias("n_words"), F.max("n").alias("copies"), F.first("base").alias("base"), F.first("label").alias("label"),
        F.first("info").alias("info"), F.min("diagonal").alias("diagonal"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"))
    # each gram adds the words up to the next one's place, at most its size; the last one all of them
    covered = total(F.zip_with("places", F.slice("places", F.lit(2), F.greatest(F.size("places"), F.lit(1))),
                               lambda a, b: F.least(F.col("info.k"), b - a)))
    g = g.withColumn("covered", F.when(F.col("template").isNotNull(), covered))
    return g.select("doc", "th", "n_words", "copies", "template", "base", "label",
                    F.greatest(F.col("diagonal") + F.element_at("places", 1), F.lit(0)).alias("first_word"),
                    (F.col("covered") / F.col("info.size")).alias("cover"), (F.col("covered") >= F.col("info.least")).alias("ok"))


def digest(docs: DataFrame) -> DataFrame:
    s = spans(docs)
    base, ok = F.col("base") & F.col("ok"), F.col("ok")
    labels = lambda cond: F.concat_ws(",", F.array_sort(F.collect_set(F.when(cond, F.col("label")))))
    g = s.groupBy("doc", "th").agg(
        F.max("n_words").alias("n_words"), F.max(F.when(F.col("template").isNull(), F.col("copies"))).alias("copies"),
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).cast("long").alias("last_word"), labels(base).alias("base_labels"),
        labels(ok).alias("labels"), F.round(F.coalesce(F.max(F.when(ok, F.col("cover"))), F.lit(0.0)), 6).alias("score"))
    one_each = g.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return one_each.select(F.col("doc").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def oracle() -> str:
    """DuckDB SQL for ``digest``: grams are joined as strings."""
    q = lambda x: "'" + str(x).replace("'", "''") + "'"
    values = ",\n".join(f"({q(name)}, {base}, {q(label)}, [{', '.join(map(q, ws))}], {k}, {slack}, {int(least)})"
                        for name, base, label, ws, k, slack, least in template_rows())
    return f"""
WITH t(template, base, label, tw, k, slack, least) AS (VALUES
{values}),
tg AS (SELECT *, array_to_string(tw[p + 1:p + k], ' ') AS gram FROM (SELECT *, unnest(range(0, len(tw) - k + 1)) AS p FROM t)),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws
      FROM documents),
dg AS (SELECT rid, k, i, array_to_string(ws[i + 1:i + k], ' ') AS gram FROM
       (SELECT rid, ws, k, unnest(range(0, len(ws) - k + 1)) AS i FROM d, (VALUES (2), (3)) AS n(k) WHERE len(ws) >= k)),
v AS (SELECT rid, template, i - p AS diagonal, list(DISTINCT p) AS places FROM dg JOIN tg USING (k, gram) GROUP BY ALL),
a AS (SELECT v.*, base, label, k, slack, least, len(tw) AS size, coalesce((diagonal - lag(diagonal) OVER
             (PARTITION BY rid, template ORDER BY diagonal) > slack)::INT, 0) AS apart FROM v JOIN t USING (template)),
r AS (SELECT *, sum(apart) OVER (PARTITION BY rid, template ORDER BY diagonal) AS run FROM a),
c AS (SELECT rid, template, run, any_value(base) AS base, any_value(label) AS label, any_value(size) AS size, any_value(least) AS least,
             min(diagonal) AS diagonal, any_value(k) AS k, list_distinct(flatten(list(places))) AS places FROM r GROUP BY ALL),
s AS (SELECT rid, base, label, size, least, greatest(diagonal + list_min(places), 0) AS first_word,
             len(list_distinct(flatten(list_transform(places, lambda p: range(p, p + k))))) AS covered FROM c),
o AS (SELECT rid, count(*) FILTER (base) AS n_base, min(first_word) FILTER (base) AS first_word, max(first_word) FILTER (base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
             max(covered / size) AS score FROM s WHERE covered >= least GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       round(coalesce(score, 0), 6)::DOUBLE AS score
FROM d LEFT JOIN o USING (rid)"""
