"""License texts found by diagonal voting.

Every k words of every text are hashed and joined, by Spark, to the positions of the
same k words in the templates. A hit votes for its diagonal (place in the text less
place in the template). Votes of a document are collected by template and diagonal;
diagonals up to ``SLACK`` words apart are merged, which bridges inserted and missing
words. A merged span is verified by the share of the template's k-grams it holds, in
a stretch not much longer than the template; from ``threshold`` on it gives a label.
A diagonal with all k-grams is a place where the template stands word for word.

The templates are a fixed list, so the join's small side is broadcast after its size is
checked; hits are counted by partial aggregation, so no document or phrase has to meet
in a task with all its words. Null text has no words. Rows with the same key and text
share one result, which is returned for each of them. An empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridpanel.llm import words

K = 3
SLACK = 2
MAX_GRAMS = 62  # the k-grams of a template are bits of a long
MAX_TEMPLATES = 10_000

# Phrases that stand for a license by themselves.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

# Opening words of public license notices.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
)


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = words.flat(texts)
    data = words.LOWER[data]
    starts, ends, rows = words.spans(data, offsets, words.ALNUM)
    return words.word_hashes(data, starts, ends), rows


def template_table(spark, templates, k: int = K) -> DataFrame:
    """``gram, template, at``: the k-grams of the templates by position."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    hashes, rows = _hashed(pa.array([text for _, text in templates], pa.string()))
    out = []
    for t in range(len(templates)):
        grams = words.window_hashes(hashes[rows[t] : rows[t + 1]], k).view(np.int64)
        if not 1 <= len(grams) <= MAX_GRAMS:
            raise ValueError(f"templates need {k} to {MAX_GRAMS + k - 1} words: {templates[t]}")
        out += [(int(g), t, i) for i, g in enumerate(grams)]
    return spark.createDataFrame(out, "gram long, template int, at int")


def _grams(docs: DataFrame, k: int) -> DataFrame:
    """``key, mark, n_words, gram, place``: a row for each k words of every text, and
    one with null gram for the text itself."""
    key_type = docs.schema["key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in words.slices(batch, "text", 2 << 20):
                hashes, rows = _hashed(part.column("text"))
                at = words.window_rows(rows, k)
                counts = np.maximum(np.diff(rows) - k + 1, 0)
                row = np.repeat(np.arange(part.num_rows), counts)
                n = np.diff(rows)
                take = pa.array(np.concatenate([np.arange(part.num_rows), row]))
                grams = words.window_hashes(hashes, k)[at].view(np.int64) if len(at) else np.zeros(0, np.int64)
                gram = pa.concat_arrays([pa.nulls(part.num_rows, pa.int64()), pa.array(grams)])
                place = np.concatenate([np.full(part.num_rows, -1), at - rows[row]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(take), part.column("mark").take(take), pa.array(n.astype(np.int64)).take(take), gram, pa.array(place)],
                    ["key", "mark", "n_words", "gram", "place"],
                )

    return docs.mapInArrow(run, f"key {key_type}, mark bigint, n_words bigint, gram bigint, place int")


def scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", phrases=PHRASES, notices=NOTICES, threshold: float = 0.6
) -> DataFrame:
    """One row for each document: ``key, n_words, n_base, first_word, last_word,
    base_labels, labels, score`` and ``spans`` (label, first word, last word, score)."""
    spark = docs.sparkSession
    templates = [*phrases, *notices]
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    picked = docs.select(F.col(f"`{key}`").alias("key"), t.alias("text"))
    picked = picked.select("key", F.xxhash64("text").alias("mark"), "text")
    joined = _grams(picked, K).join(F.broadcast(template_table(spark, templates)), "gram", "left")
    bit = F.expr("shiftleft(1L, at)")
    diagonals = joined.groupBy("key", "mark", "n_words", "template", (F.col("place") - F.col("at")).alias("diagonal")).agg(
        F.bit_or(bit).alias("seen"),
        F.min("place").alias("first"),
        F.max("place").alias("last"),
        F.sum(F.when(F.col("place") == -1, 1).otherwise(0)).alias("rows"),
    )
    by_template = Window.partitionBy("key", "mark", "template").orderBy("diagonal")
    jump = F.col("diagonal") - F.lag("diagonal").over(by_template) > SLACK
    numbered = diagonals.withColumn("jump", F.coalesce(jump.cast("int"), F.lit(0)))
    numbered = numbered.withColumn("span", F.sum("jump").over(by_template.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = [len(text.split()) for _, text in templates]
    n_grams = F.element_at(F.array(*[F.lit(n - K + 1) for n in sizes]), F.col("template") + 1)
    label = F.element_at(F.array(*[F.lit(name) for name, _ in templates]), F.col("template") + 1)
    exact = (F.bit_count("seen") == n_grams) & (F.col("template") < len(phrases))
    spans = numbered.groupBy("key", "mark", "n_words", "template", "span").agg(
        F.bit_count(F.bit_or("seen")).alias("held"),
        F.min("first").alias("first"),
        (F.max("last") + K - 1).alias("last"),
        F.count(F.when(exact, 1)).alias("n_base"),
        F.min(F.when(exact, F.col("diagonal"))).alias("base_first"),
        F.max(F.when(exact, F.col("diagonal"))).alias("base_last"),
        F.sum("rows").alias("rows"),
    )
    n_words = n_grams + K - 1
    tight = F.col("last") - F.col("first") < n_words + F.greatest(F.lit(SLACK), n_words / 4)
    share = F.when(F.col("template").isNull(), 0.0).when(F.col("n_base") > 0, 1.0).when(tight, F.col("held") / n_grams)
    scored = spans.withColumn("score", F.coalesce(share, F.lit(0.0))).withColumn("label", label)
    hit = F.col("score") >= threshold
    found = scored.groupBy("key", "mark", "n_words").agg(
        F.sum("rows").alias("rows"),
        F.sum("n_base").alias("n_base"),
        F.min("base_first").cast("long").alias("first_word"),
        F.max("base_last").cast("long").alias("last_word"),
        F.collect_set(F.when(F.col("n_base") > 0, F.col("label"))).alias("base"),
        F.collect_set(F.when(hit, F.col("label"))).alias("all"),
        F.collect_list(F.when(hit, F.struct("label", "first", "last", "score"))).alias("spans"),
        F.max("score").alias("score"),
    )
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))
    return found.withColumn("copy", each).select(
        "key",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort("all"), ",").alias("labels"),
        "score",
        "spans",
    )
