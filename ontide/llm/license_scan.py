"""License scan: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Only DataFrame functions run. A text's words (letters and digits, lower case) give hashed three-word
shingles; windows of eight shingles start every fourth, so they overlap by half. A window's signature has a
minimum per seed, and each minimum is a band of its own. A band retrieves the templates that
have the shingle of the minimum. The number of bands follows from the promise: a window that
shares at least `least_shared` of its shingles with a template must collide with a probability of
`collision` or more. Three shared of eight, the shortest template, take 15 bands for 0.999.

For every retrieved template the shingles around the window, a template's length to both sides, are
compared exactly; the share of the template's shingles found there is its containment. A row is
given per document and template with a containment of `threshold` or more.

Null, empty and short texts (under three words) have no shingles and no rows. Rows of one id,
a null one included, are reported together; repeated rows add windows, not rows. Other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SHINGLE = 3
WINDOW = 8
STRIDE = 4

# License statements.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the "
        "License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3",
    "GPL header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation"
    ),
    "MIT line": "Released under the MIT License",
    "MIT permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and associated documentation files (the \"Software\"), to deal in the Software without restriction"
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met"
    ),
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
        "fee is hereby granted"
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain",
}


def band_seeds(least_shared: float, collision: float) -> list[int]:
    """As many seeds as one-row bands are needed. A seed flips bits of well-mixed hashes; they
    differ in their top bits, so each looks at another end of the order."""
    n = math.ceil(math.log(1 - collision) / math.log(1 - least_shared))
    step = (1 << 64) // n
    return [((i * step + step // 3) % (1 << 64)) - (1 << 63) for i in range(n)]


def words_of(text: Column) -> Column:
    parts = F.split(F.lower(text), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    return F.array_remove(parts, "")


def with_shingles(rows: DataFrame, text: str) -> DataFrame:
    """Adds `shingles`: hashes of the three-word shingles in order, null where there are none.

    Nothing filters on derived columns here: a filter would be pushed below them and split the
    text again for every shingle.
    """
    worded = rows.withColumn("words", words_of(F.col(text)))
    hashed = F.transform(
        F.sequence(F.lit(0), F.size("words") - SHINGLE),
        lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(SHINGLE))),
    )
    return worded.withColumn("shingles", F.when(F.size("words") >= SHINGLE, hashed)).drop("words", text)


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(license, shingles): the distinct shingles of each template."""
    pairs = [F.struct(F.lit(k).alias("license"), F.lit(v).alias("body")) for k, v in templates.items()]
    rows = spark.range(1).select(F.inline(F.array(*pairs)))
    return with_shingles(rows, "body").withColumn("shingles", F.array_distinct("shingles"))


def signature(window: Column, seeds: list[int]) -> Column:
    """The shingle that has the smallest hash under each seed."""

    def least(seed):
        return F.array_min(F.transform(window, lambda h: h.bitwiseXOR(F.lit(seed)))).bitwiseXOR(F.lit(seed))

    return F.array(*(least(seed) for seed in seeds))


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    threshold: float = 0.8,
    least_shared: float = 3 / 8,
    collision: float = 0.999,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, license, containment, n_windows, first_shingle per document and matching template."""
    templates, seeds = templates or TEMPLATES, band_seeds(least_shared, collision)
    # the templates are a fixed list; it is as large as the code
    known = template_table(docs.sparkSession, templates)
    fixed = known.collect()
    reach = max(len(row["shingles"]) for row in fixed)
    entries = sorted({h for row in fixed for h in row["shingles"]})

    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("body"))
    hashed = with_shingles(rows, "body")
    n = F.size("shingles")
    last = F.greatest(F.lit(0), F.ceil((n - WINDOW) / STRIDE)).cast("int")

    def collides(i):
        window = F.slice("shingles", i * STRIDE + 1, F.lit(WINDOW))
        return F.exists(signature(window, seeds), lambda h: h.isin(entries))

    def found(i):
        start = F.greatest(F.lit(1), i * STRIDE + 1 - reach)
        return F.struct(
            (i * STRIDE).alias("start"),
            signature(F.slice("shingles", i * STRIDE + 1, F.lit(WINDOW)), seeds).alias("heads"),
            F.slice("shingles", start, i * STRIDE + 1 - start + WINDOW + reach).alias("around"),
            (i * STRIDE + 1 - start).alias("lead"),
        )

    hits = F.transform(F.filter(F.sequence(F.lit(0), last), collides), found)
    windows = hashed.select("doc_id", F.inline(F.when(n > 0, hits)))
    postings = known.select("license", F.col("shingles").alias("own"), F.explode("shingles").alias("head"))
    retrieved = (
        windows.withColumn("head", F.explode(F.array_distinct("heads")))
        .join(F.broadcast(postings), "head")
        .drop("head", "heads")
        .dropDuplicates(["doc_id", "start", "license"])
    )
    size = F.size("own")
    first = F.greatest(F.lit(1), F.col("lead") + 1 - size)
    region = F.slice("around", first, F.col("lead") + 1 - first + WINDOW + size)
    share = F.size(F.array_intersect("own", region)) / size
    return (
        retrieved.withColumn("containment", share)
        .filter(F.col("containment") >= threshold)
        .groupBy("doc_id", "license")
        .agg(
            F.max("containment").alias("containment"),
            F.count("*").alias("n_windows"),
            F.min("start").cast("bigint").alias("first_shingle"),
        )
    )
