"""License scan by diagonal voting.

Every place of a document from which k words stand gives a code of these words. Spark joins the
codes of all documents to the places of the templates that have them; a hit at word p of the
document and word t of a template votes for the diagonal p - t. Votes are counted per document,
template and diagonal before anything is shuffled. Diagonals that differ by a few words (inserted
or missing ones) are merged to a span, and a span is verified: the template's words that its
hits cover must be most of the template.

Base phrases are counted at each place where their words stand one after another; the method adds
the labels of verified spans.

Defined results: words are lower-cased (A-Z) runs of a-z, 0-9 and non-ASCII characters; a null or
empty text has none, no labels and score 0; rows of equal id, or without one, are documents each,
voting by their own texts; repeated rows stay; a text of any length is read whole (runs of 1 MB, a
longer text is a run of its own), only its hits leave the task; no rows give none. Only the named columns are read, so extra
columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.llm.jaccard import text_code
from wayline.llm.tables import arrow_schema, as_table
from wayline.llm.words import ALPHANUMERIC, U64, rolling, words_of

#: Phrases, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Label → notices of public licenses.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ],
    "lgpl": ["under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
}
GRAM = 3
#: Diagonals this far apart at most are neighbours.
SLACK = 3
#: Share of a template's words that a span must cover.
COVERED = 0.8


def _codes(text: str) -> np.ndarray:
    (words,) = words_of(pa.array([text]), ALPHANUMERIC, lower=True)
    return words.codes()


def template_grams(spark: SparkSession, templates: dict[str, list[str]], k: int) -> DataFrame:
    """gram, template, label, at, size: a row for each place of a template. As large as the templates given."""
    rows, number = [], 0
    for label, texts in templates.items():
        for text in texts:
            codes = _codes(text)
            for at, gram in enumerate(rolling(codes, k).view(np.int64).tolist()):
                rows.append((gram, number, label, at, len(codes)))
            number += 1
    return spark.createDataFrame(rows, "gram long, template int, label string, at int, size int")


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The code tells rows of one id apart; rows that are equal in both find the same."""
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), text_code(text).alias("text_code"))


def base_places(docs: DataFrame, id_col: str, text_col: str, phrases: dict[str, str]) -> DataFrame:
    """doc_id, text_code, n_words, n_base, first_word, last_word, found (labels) of each document."""
    narrow = _narrow(docs, id_col, text_col)
    kind = narrow.schema["doc_id"].dataType.simpleString()
    out = arrow_schema(kinds := f"doc_id {kind}, text_code binary, n_words long, n_base long, first_word long, last_word long, found array<string>")
    wanted = [(label, _codes(phrase)) for phrase, label in phrases.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            counts, hits, first, last = np.zeros(n, np.int64), np.zeros(n, np.int64), [None] * n, [None] * n
            labels: list[set[str]] = [set() for _ in range(n)]
            for w in words_of(batch.column(1), ALPHANUMERIC, lower=True):
                codes, row = w.codes(), w.row
                counts[w.first : w.first + w.n_rows] = w.counts
                for label, phrase in wanted:
                    places = w.windows(len(phrase))
                    for i, word in enumerate(phrase):
                        places = places[codes[places + i] == word]
                    for place, r in zip(places.tolist(), row[places].tolist()):
                        at, d = place - int(w.bounds[r]), w.first + r
                        hits[d] += 1
                        first[d] = at if first[d] is None else min(first[d], at)
                        last[d] = at if last[d] is None else max(last[d], at)
                        labels[d].add(label)
            columns = {"doc_id": batch.column(0), "text_code": batch.column(2), "n_words": counts, "n_base": hits, "first_word": first, "last_word": last}
            yield from as_table(columns | {"found": [sorted(x) for x in labels]}, out).to_batches()

    return narrow.mapInArrow(run, kinds)


def grams(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """doc_id, text_code, place, gram: a row for every place of every document."""
    narrow = _narrow(docs, id_col, text_col)
    kind = narrow.schema["doc_id"].dataType.simpleString()
    out = arrow_schema(kinds := f"doc_id {kind}, text_code binary, grams array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words_of(batch.column(1), ALPHANUMERIC, lower=True):
                places = w.windows(k)
                codes = rolling(w.codes(), k)[places].astype(U64).view(np.int64)
                sizes = np.concatenate([[0], np.cumsum(np.maximum(0, w.counts - k + 1))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(codes))
                own = {c: batch.column(i).slice(w.first, w.n_rows) for c, i in (("doc_id", 0), ("text_code", 2))}
                columns = own | {"grams": lists.cast(out.field("grams").type)}
                yield from as_table(columns, out).to_batches()

    return narrow.mapInArrow(run, kinds).select("doc_id", "text_code", F.posexplode("grams").alias("place", "gram"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] = TEMPLATES, k: int = GRAM, slack: int = SLACK, least: float = COVERED) -> DataFrame:
    """Verified spans: doc_id, text_code, template, label, first_place, last_place (words), covered (share of the template)."""
    where = template_grams(docs.sparkSession, templates, k)
    # as large as the templates in the code, whatever the corpus is
    hits = grams(docs, id_col, text_col, k).join(F.broadcast(where), "gram")
    votes = hits.groupBy("doc_id", "text_code", "template", "label", "size", (F.col("place") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("ats"),
        F.min("place").alias("first_place"),
        F.max("place").alias("last_place"),
    )
    along = Window.partitionBy("doc_id", "text_code", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > slack, F.lit(True))
    merged = votes.withColumn("span", F.sum(apart.cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    found = merged.groupBy("doc_id", "text_code", "template", "label", "size", "span").agg(
        F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"),
        F.min("first_place").alias("first_place"),
        (F.max("last_place") + k - 1).alias("last_place"),
    )
    words = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda t: F.sequence(t, t + k - 1)))))
    found = found.withColumn("covered", words / F.col("size"))
    return found.where(F.col("covered") >= least).select("doc_id", "text_code", "template", "label", "first_place", "last_place", "covered")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Score: the largest share of a template that a verified span covers, and 1 with a base phrase.
    """
    base = base_places(docs, id_col, text_col, phrases)
    seen = spans(docs, id_col, text_col, **options).groupBy(F.col("doc_id").alias("seen_id"), F.col("text_code").alias("seen_code")).agg(F.collect_set("label").alias("more"), F.max("covered").alias("best"))
    rows = base.join(seen, base["doc_id"].eqNullSafe(seen["seen_id"]) & (base["text_code"] == seen["seen_code"]), "left")
    labels = F.array_sort(F.array_distinct(F.concat("found", F.coalesce("more", F.array().cast("array<string>")))))
    return rows.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("found", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
