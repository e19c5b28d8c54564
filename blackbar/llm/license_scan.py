"""License notices in texts: MinHash bands over overlapping windows, verified by containment.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blackbar.llm.common import store

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 64

# Short notices as licensors write them, with a name and a kind.
TEMPLATES = [
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "permissive", "Released under the MIT License."),
    ("MIT", "permissive", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("BSD-3-Clause", "permissive", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-or-later", "copyleft", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "copyleft", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "copyleft", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "copyleft", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "noncommercial", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "public domain", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
]


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where the body names it in a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def words(text: Column) -> Column:
    """Runs of letters and digits, lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(w: Column, shingle: int = SHINGLE) -> Column:
    """The 64-bit hash of every run of ``shingle`` words; none if there are fewer words."""
    last = F.size(w) - shingle
    hashed = lambda i: F.xxhash64(*[F.get(w, i + d) for d in range(shingle)])
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), hashed)).otherwise(F.array().cast("array<bigint>"))


def shingle_texts(w: Column, shingle: int = SHINGLE) -> Column:
    last = F.size(w) - shingle
    joined = lambda i: F.array_join(F.slice(w, i + 1, F.lit(shingle)), " ")
    return F.when(last >= 0, F.array_distinct(F.transform(F.sequence(F.lit(0), last), joined))).otherwise(
        F.array().cast("array<string>")
    )


def minima(hashes: Column, bands: int) -> Column:
    """Of each band's hash function, the least value over the shingles."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda j: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, j))),
    )


def template_table(spark: SparkSession, templates=TEMPLATES, shingle: int = SHINGLE) -> DataFrame:
    """template_no, license, kind, shingles, hashes, stride: windows are two strides long.

    The stride is the least power of two with room for the template, so that wherever it
    stands in a text, one window holds all of it and at most four times as many shingles.
    """
    rows = F.inline(F.array(*[
        F.struct(F.lit(i).alias("template_no"), *[F.lit(v).alias(k) for k, v in zip(("license", "kind", "notice"), t)])
        for i, t in enumerate(templates)
    ]))
    found = spark.range(1).select(rows).withColumn("w", words(F.col("notice")))
    found = found.select(
        "template_no", "license", "kind",
        let(F.col("w"), lambda w: shingle_texts(w, shingle)).alias("shingles"),
        F.array_distinct(let(F.col("w"), lambda w: shingle_hashes(w, shingle))).alias("hashes"),
        F.greatest(F.size("w") - shingle, F.lit(1)).alias("room"),
    ).where(F.size("hashes") > 0)
    return store(found.withColumn("stride", F.pow(F.lit(2), F.ceil(F.log2("room"))).cast("int")).drop("room"), "templates")


def collision_probability(containment: float = CONTAINMENT, bands: int = BANDS) -> float:
    """Least probability that a window with a template of this containment shares a band.

    With n shingles in the template and at most 4n in the window, at least ``containment * n``
    of them shared, the Jaccard similarity is at least containment / (5 - containment).
    """
    return 1 - (1 - containment / (5 - containment)) ** bands


def license_scan(
    docs: DataFrame,
    templates: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    containment: float = CONTAINMENT,
    bands: int = BANDS,
) -> DataFrame:
    """One row per document and license: doc_id, license, kind, containment, first_word, n_windows.

    Windows of two strides of shingles start at every multiple of a stride; templates of like
    length share a stride. A window and a template are compared if one of ``bands`` MinHash
    values is equal (see ``collision_probability``), and match if at least ``containment`` of
    the template's shingles, as texts, are in the window. As an equal minimum is the hash of a
    shingle that both have, only windows with some template's shingle are formed.

    ``containment`` is the best of the license's windows, ``first_word`` the first word of the
    first such window, ``n_windows`` how many match. Null, empty and short texts match nothing.
    Repeated ids are one document; null ids are a group of their own. An empty table gives
    no rows. Only the two named columns are read. The templates (see ``template_table``) are
    broadcast: their number is that of the list they are made from, not of the texts.
    """
    spark = docs.sparkSession
    templates = template_table(spark, shingle=shingle) if templates is None else templates
    known = templates.select("hashes", "stride").collect()
    if not known:
        templates = template_table(spark, shingle=shingle)
    grams = sorted({h for r in known for h in r["hashes"]})
    strides = sorted({r["stride"] for r in known})
    in_template = F.array(*[F.lit(g) for g in grams]).cast("array<bigint>")
    hashes = let(words(F.col(text_col)), lambda w: shingle_hashes(w, shingle))
    rows = docs.where(F.arrays_overlap(hashes, in_template)).select(
        F.col(id_col).cast("bigint").alias("doc_id"), words(F.col(text_col)).alias("w"), hashes.alias("h")
    )
    rows = store(rows, "texts")
    # the places of template shingles, and the windows of each stride that hold them
    places = F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda i: F.array_contains(in_template, F.get(F.col("h"), i)))

    def around(p: Column, stride: int) -> Column:
        k = F.floor(p / stride).cast("int")
        return F.array(*[F.struct(F.lit(stride).alias("stride"), ((k - d) * stride).alias("first")) for d in (0, 1)])

    begins = F.flatten(F.transform(places, lambda p: F.flatten(F.array(*[around(p, s) for s in strides]))))
    windows = rows.select(
        "doc_id", "w", "h", F.explode(F.array_distinct(begins)).alias("b")
    ).where("b.first >= 0").select(
        "doc_id",
        F.col("b.stride").alias("stride"),
        F.col("b.first").alias("first"),
        F.slice("w", F.col("b.first") + 1, 2 * F.col("b.stride") + (shingle - 1)).alias("w"),
        F.array_distinct(F.slice("h", F.col("b.first") + 1, 2 * F.col("b.stride"))).alias("h"),
    )
    windows = store(windows, "windows")
    signed = windows.select("doc_id", "stride", "first", "w", F.posexplode(minima(F.col("h"), bands)).alias("band", "least"))
    filed = templates.select(
        "template_no", "license", "kind", "shingles", "stride", F.posexplode(minima(F.col("hashes"), bands)).alias("band", "least")
    )
    found = signed.join(F.broadcast(filed), ["stride", "band", "least"]).dropDuplicates(["doc_id", "stride", "first", "template_no", "w"])
    part = F.size(F.array_intersect(let(F.col("w"), lambda w: shingle_texts(w, shingle)), F.col("shingles"))) / F.size("shingles")
    matched = found.withColumn("containment", part).where(F.col("containment") >= containment)
    return matched.groupBy("doc_id", "license", "kind").agg(
        F.max("containment").alias("containment"),
        F.min_by("first", F.struct(-F.col("containment"), F.col("first"))).cast("bigint").alias("first_word"),
        F.count(F.lit(1)).alias("n_windows"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
