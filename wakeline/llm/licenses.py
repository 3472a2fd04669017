"""License scan by diagonal voting, in DataFrame operations only.

Words are lower-cased (A-Z) maximal runs of characters that are ASCII letters or digits, or not ASCII. Every rolling
K-word hash of a document is joined to the places of the same hash in the templates, and the words behind the hash are
compared. A match votes for the diagonal (word of the document less word of the template). Votes of neighbouring
diagonals are merged: a diagonal with votes of its own gets those of all diagonals within the template's drift too, so a
few inserted or missing words don't break a span. Each place of a template counts once for a span, and a span is
accepted when enough of the template's places are found in it. Copies of a template that follow each other are far
enough apart to be spans of their own. A base phrase is a template that counts only where all of it stands on one
diagonal.

The state of a span is fixed in size: places are bits of numbers that hash aggregation joins by OR, so no place, span or
label is gathered in a list. A document is handled whole, whatever its length; its words are one array of its row.

Defined results: an empty table gives no rows; a null or wordless text has no words and no labels; repeated rows are
scanned one by one; where labels tie, all are given; extra columns play no part, whatever their names. Templates beyond
MOST_BROADCAST places are joined by shuffle instead of broadcast.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import DOC_ID, TEXT

K = 3
#: Diagonals at most this far apart, and at most a fourth of the template's length, are one span.
DRIFT = 3
#: Share of a template's K-word places that a span must cover.
LEAST_COVER = 0.6
MOST_BROADCAST = 200_000
_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands before a document's words, so that each document joins at least once.
_MARK = 0x5CA1AB1E


class Template(NamedTuple):
    label: str
    text: str
    base: bool = False


BASE = [Template("mit", "under the mit license", True), Template("apache-2", "apache license version 2", True), Template("cc-by-nc", "cc by nc", True)]
METHOD = [
    Template("mit", "Released under the MIT License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    Template("apache-2", "Licensed under the Apache License, Version 2.0"),
    Template("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("gpl-3", "licensed under the GNU General Public License, version 3"),
    Template("gpl-3", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    Template("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("cc-by", "Creative Commons Attribution 4.0 International License"),
    Template("proprietary", "All rights reserved"),
]


def template_words(text: str) -> list[str]:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return [w for w in re.split(_SEPARATOR, lower) if w]


def words(text: Column) -> Column:
    """The words of a text. U+212A is the one letter beyond ASCII that lower() would make an ASCII letter."""
    parts = F.split(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ"))), _SEPARATOR)
    return parts


def _local(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A literal relation; nothing is sent through Python workers."""
    names = [x.split()[0] for x in schema.split(", ")]
    literal = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, r, strict=True))) for r in rows)).cast(f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in schema.split(', '))}>>")
    return spark.range(1).select(F.inline(literal))


def _places(spark, templates: list[Template]) -> DataFrame:
    """(gram, phrase, template, place), with _MARK for template -1."""
    rows = [(t, i, *w[i : i + K]) for t, w in enumerate(template_words(x.text) for x in templates) for i in range(len(w) - K + 1)]
    found = _local(spark, rows, "template int, place int, " + ", ".join(f"w{j} string" for j in range(K)))
    names = [f"w{j}" for j in range(K)]
    found = found.select(F.xxhash64(*names).alias("gram"), F.concat_ws(" ", *names).alias("phrase"), "template", "place")
    mark = spark.range(1).select(F.lit(_MARK).cast("long").alias("gram"), F.lit("").alias("phrase"), F.lit(-1).alias("template"), F.lit(0).alias("place"))
    found = found.union(mark)
    return F.broadcast(found) if len(rows) <= MOST_BROADCAST else found


def votes(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """(row, doc_id, n_words, template, diagonal, place): verified matches, and a row of template -1 per document."""
    parts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(DOC_ID).cast("long").alias(DOC_ID), words(F.col(TEXT)).alias("w"))
    # the separators at either end leave an empty string there
    parts = parts.select("row", DOC_ID, F.slice("w", F.when(F.get("w", F.lit(0)) == "", 2).otherwise(1), F.size("w")).alias("w"))
    parts = parts.select("row", DOC_ID, "w", (F.size("w") - F.when(F.get("w", F.size("w") - 1) == "", 1).otherwise(0)).alias("n_words"))
    heads = F.slice("w", F.lit(1), F.greatest(F.lit(0), F.col("n_words") - K + 1))
    grams = F.transform(heads, lambda w, i: F.xxhash64(w, *(F.get("w", i + j) for j in range(1, K))))
    found = parts.select("row", DOC_ID, F.col("n_words").cast("long").alias("n_words"), "w", F.posexplode(F.concat(F.array(F.lit(_MARK).cast("long")), grams)).alias("at", "gram"))
    own = F.concat_ws(" ", *(F.get("w", F.col("at") - 1 + j) for j in range(K)))
    known = _places(docs.sparkSession, templates)
    if sum(len(template_words(t.text)) for t in templates) > MOST_BROADCAST:  # words don't go into a shuffle of all grams
        found = found.select("row", DOC_ID, "n_words", "at", "gram", own.alias("own"))
        own = F.col("own")
    found = found.join(known, "gram").where(F.when(F.col("template") < 0, F.col("at") == 0).otherwise((F.col("at") > 0) & (F.col("phrase") == own)))
    return found.select("row", DOC_ID, "n_words", "template", (F.col("at") - 1 - F.col("place")).alias("diagonal"), "place")


def _known(templates: list[Template]) -> list[tuple]:
    """(template, grams, length, drift, label, base)."""
    own = [(t, len(template_words(t.text))) for t in templates]
    return [(i, n - K + 1, n, 0 if t.base else min(DRIFT, n // 4), t.label, t.base) for i, (t, n) in enumerate(own)]


def _spans(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """Accepted spans of each diagonal that has votes, and a row of template -1 per document."""
    short = [t for t in templates if len(template_words(t.text)) < K]
    if short:
        raise ValueError(f"a template needs {K} words: {short}")
    known = _known(templates)
    sizes = F.broadcast(_local(docs.sparkSession, known, "template int, grams int, length int, drift int, label string, base boolean"))
    found = votes(docs, templates).repartition("row").join(sizes, "template", "left")
    drift = F.coalesce("drift", F.lit(0))
    found = found.withColumn("shift", F.explode(F.sequence(-drift, drift))).withColumn("anchor", F.col("diagonal") + F.col("shift"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place") % 64)
    near, own = [], []
    for p in range(max(g for _, g, *_ in known) // 64 + 1):
        here = F.floor(F.col("place") / 64) == p
        near.append(F.bit_count(F.bit_or(F.when(here, bit))))
        own.append(F.bit_count(F.bit_or(F.when(here & (F.col("shift") == 0), bit))))

    def total(of: list[Column]) -> Column:
        return sum((F.coalesce(x, F.lit(0)) for x in of), F.lit(0))

    at = F.col("diagonal") + F.col("place")
    found = found.groupBy("row", DOC_ID, "n_words", "template", "anchor").agg(total(near).alias("covered"), total(own).alias("own"), F.min(at).alias("start"), (F.max(at) + K).alias("end")).join(sizes, "template", "left")
    fits = (F.col("template") < 0) | F.when(F.col("base"), F.col("own") == F.col("grams")).otherwise((F.col("own") > 0) & (F.col("covered") >= F.col("grams") * LEAST_COVER))
    return found.where(fits).withColumn("cover", F.col("covered") / F.col("grams"))


def spans(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """(row, doc_id, template, label, start, end, cover): of neighbouring diagonals' spans the one that covers most."""
    found = _spans(docs, templates).where("template >= 0")
    near = W.partitionBy("row", "template").orderBy("anchor").rangeBetween(-DRIFT, DRIFT)
    found = found.withColumn("near", F.collect_list(F.struct("covered", "anchor")).over(near))  # 2 * DRIFT + 1 at most
    better = F.exists("near", lambda x: (F.abs(x["anchor"] - F.col("anchor")) <= F.col("drift")) & ((x["covered"] > F.col("covered")) | ((x["covered"] == F.col("covered")) & (x["anchor"] < F.col("anchor")))))
    return found.where(~better).select("row", DOC_ID, "template", "label", "start", "end", "cover")


def scan(docs: DataFrame, base: list[Template] | None = None, method: list[Template] | None = None) -> DataFrame:
    """One row per document: words, places of base phrases, their first and last, labels, and the best span's cover."""
    templates = [t._replace(base=True) for t in (BASE if base is None else base)] + list(METHOD if method is None else method)
    names = sorted({t.label for t in templates})
    own = F.col("base")

    def labels(of: Column) -> Column:
        """Names whose flag any span sets; each flag is a number, so that hash aggregation can hold it."""
        return F.array_join(F.array_compact(F.array(*(F.when(F.max(F.when(of & (F.col("label") == n), 1)) == 1, F.lit(n)) for n in names))), ",")

    return _spans(docs, templates).groupBy("row", DOC_ID, "n_words").agg(
        F.count_if(own).cast("long").alias("n_base"),
        F.min(F.when(own, F.col("anchor"))).cast("long").alias("first_word"),
        F.max(F.when(own, F.col("anchor"))).cast("long").alias("last_word"),
        labels(own).alias("base_labels"),
        labels(F.col("template") >= 0).alias("labels"),
        F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
    ).drop("row")
