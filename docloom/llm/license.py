"""License scans by diagonal voting.

Templates are word sequences: short phrases, which make the base labels, and
whole license notices, which make the method's own.  Every run of k words of a
document is hashed (k = 2 for phrases, 5 for notices) and joined with the runs
of the templates; a hit at document word d and template word t votes for the
diagonal d - t.  Hits are aggregated by document, template and diagonal.  A
phrase stands where all its runs vote on one diagonal.  In notices, words may be
put in or left out, which moves the rest to a neighbouring diagonal; so
diagonals at most ``DRIFT`` apart, or half of a longer notice's runs, are merged,
and a merged span is verified: it must hold at least ``COVER`` of the notice's
runs, each once and in the notice's order.

The pass over the texts hashes every run of every document, and writes those
that pass a bit table of the template hashes; the table keeps every run of a
template and some hundredths of a percent of the others, so that not all runs
need to leave Python.  The join decides, on the hash and on the words
themselves.  The template table is fixed in size, so it may be broadcast.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .shared import Scratch

#: Phrases and their base labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Labels and the public license notices that they stand for, whole ones and those of one line.
NOTICES = {
    "notice-apache": ("Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0"),
    "notice-mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so",
        "Released under the MIT License", "Licensed under the MIT License", "SPDX-License-Identifier: MIT",
    ),
    "notice-bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
        "SPDX-License-Identifier: BSD-2-Clause", "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "notice-isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "notice-gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation",
        "licensed under the GNU General Public License, version", "GNU General Public License as published by the Free Software Foundation",
    ),
    "notice-lgpl": ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "notice-cc": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "licensed under a Creative Commons Attribution", "Licensed under CC BY-NC", "Licensed under CC BY-SA", "Licensed under CC BY 4.0",
    ),
    "notice-mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "notice-public-domain": ("This is free and unencumbered software released into the public domain", "dedicated to the public domain under CC0"),
}

PHRASE_K, NOTICE_K = 2, 5
DRIFT = 3
COVER = 0.6
#: The bit table of the template hashes has two to this many places.
TABLE_BITS = 20


def _split(text: str) -> list[bytes]:
    return [bytes(w.data[s:e]) for w in W.words(pa.array([text]), W.ALNUM) for s, e in zip(w.starts, w.ends)]


def templates() -> list[tuple[str, bool, int, int, int, int, str]]:
    """(label, base, template, k, position, hash, words) for each run of each template."""
    out = []
    named = [(text, label, True) for text, label in PHRASES.items()] + [(text, label, False) for label, texts in NOTICES.items() for text in texts]
    for n, (text, label, base) in enumerate(named):
        found = _split(text)
        k = PHRASE_K if base else min(NOTICE_K, len(found))
        (w,) = W.words(pa.array([text]), W.ALNUM)
        for i, h in enumerate(W.grams(w.hashes, k).view(np.int64).tolist()):
            out.append((label, base, n, k, i, h, b" ".join(found[i : i + k]).decode()))
    return out


def _hits(ks: list[int], wanted: dict[int, np.ndarray]):
    """Per row: the number of words, and place, k, hash and words of the runs that a template may hold."""

    def bits(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    tables = {}
    for k in ks:
        tables[k] = np.zeros(1 << TABLE_BITS, bool)
        tables[k][bits(wanted[k])] = True
    kind = pa.list_(pa.struct([("at", pa.int64()), ("k", pa.int32()), ("hash", pa.int64()), ("run", pa.string())]))

    def run(batches):
        for batch in batches:
            counts, hits = [], [[] for _ in range(batch.num_rows)]
            for w in W.words(batch.column("text"), W.ALNUM):
                counts += np.diff(w.first).tolist()
                for k in ks:
                    h = W.grams(w.hashes, k)
                    at = np.flatnonzero(tables[k][bits(h)])
                    row = np.searchsorted(w.first, at, "right") - 1
                    inside = at + k <= w.first[row + 1]  # a run ends in the row where it starts
                    for i, r in zip(at[inside].tolist(), row[inside].tolist()):
                        words = b" ".join(bytes(w.data[w.starts[j] : w.ends[j]]) for j in range(i, i + k)).decode()
                        hits[w.row + r].append({"at": i - int(w.first[r]), "k": k, "hash": int(h[i].view(np.int64)), "run": words})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hits, kind)], names=["doc_id", "n_words", "hits"])

    return run


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text).

    (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    spans): n_base places of base phrases, overlapping ones too, starting at
    words first_word to last_word (null without any); labels are comma-joined;
    spans are the verified (label, first, last, share) in order of their words,
    with the share of the template's runs; score is the largest such share, 1
    where a phrase stands, 0 without any.  A null
    text is an empty one; rows that repeat are scanned each; a null doc_id is
    returned as such.  An empty table gives an empty one; other columns play no
    part.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "license")
    known = templates()
    ks = sorted({t[3] for t in known})
    wanted = {k: np.array([t[5] for t in known if t[3] == k], np.int64).view(np.uint64) for k in ks}
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hits = "array<struct<at:bigint,k:int,hash:bigint,run:string>>"
    pages = scratch.save(base.mapInArrow(_hits(ks, wanted), f"doc_id long, n_words long, hits {hits}").withColumn("row", F.monotonically_increasing_id()))

    schema = "label string, base boolean, template int, k int, position long, hash long, run string"
    table = spark.createDataFrame([(a, b, c, d, e, f, g) for a, b, c, d, e, f, g in known], schema)
    size = table.groupBy("template").agg(F.count("*").alias("runs"))
    found = pages.where(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select("row", "h.*")
    votes = found.join(F.broadcast(table), ["k", "hash", "run"])  # the table is that of this module
    diagonals = votes.groupBy("row", "template", "label", "base", (F.col("at") - F.col("position")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("at").alias("low"), (F.max(F.col("at") + F.col("k")) - 1).alias("high"),
        F.collect_list(F.when(~F.col("base"), F.struct("at", (-F.col("position")).alias("back")))).alias("runs_at"),
    ).join(F.broadcast(size), "template")
    spans = scratch.save(_spans(diagonals))
    by_row = spans.groupBy("row").agg(
        F.count(F.when(F.col("base"), 1)).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("low"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("low"))).alias("last_word"),
        F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set("label")).alias("labels"),
        F.max("share").alias("score"),
        F.array_sort(F.collect_list(F.struct(F.col("low").alias("first"), F.col("high").alias("last"), "label", "share"))).alias("spans"),
    )
    out = pages.select("row", "doc_id", "n_words").join(by_row, "row", "left")
    listed = lambda c: F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        listed("base_labels"), listed("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("spans", F.array().cast("array<struct<first:bigint,last:bigint,label:string,share:double>>")).alias("spans"),
    )


def _spans(diagonals: DataFrame) -> DataFrame:
    """Verified spans: a phrase's full diagonals, and notices merged over neighbouring diagonals."""
    kept = ["row", "template", "label", "base", "low", "high", "share"]
    exact = diagonals.where(F.col("base") & (F.col("votes") == F.col("runs"))).withColumn("share", F.lit(1.0)).select(*kept)
    one = Window.partitionBy("row", "template").orderBy("diagonal", "low")
    near = diagonals.where(~F.col("base")).withColumn("step", F.col("diagonal") - F.lag("diagonal").over(one))
    new = F.coalesce(F.col("step") > F.greatest(F.lit(DRIFT), F.floor(F.col("runs") / 2)), F.lit(True)).cast("int")
    near = near.withColumn("span", F.sum(new).over(one))
    merged = near.groupBy("row", "template", "label", "base", "span").agg(
        F.sum("votes").alias("votes"), F.min("low").alias("low"), F.max("high").alias("high"), F.first("runs").alias("runs"),
        F.array_sort(F.flatten(F.collect_list("runs_at"))).alias("runs_at"),
    )
    merged = merged.where(F.col("votes") >= COVER * F.col("runs")).select("row", "template", "label", "base", "low", "high", "runs", "runs_at")
    types = dict(merged.dtypes)
    merged = merged.mapInArrow(_shares, ", ".join(f"{c} {types.get(c, 'double')}" for c in kept)).where(F.col("share") >= COVER)
    return exact.unionByName(merged.select(*kept))


def in_order(positions: list[int]) -> int:
    """The most positions that rise strictly, in the order given."""
    ends: list[int] = []
    for p in positions:
        i = bisect_left(ends, p)
        ends[i : i + 1] = [p]
    return len(ends)


def _shares(batches):
    for batch in batches:
        share = [in_order([-h["back"] for h in hits]) / runs for hits, runs in zip(batch.column("runs_at").to_pylist(), batch.column("runs").to_pylist())]
        columns = ["row", "template", "label", "base", "low", "high"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(share, pa.float64())], names=[*columns, "share"])
