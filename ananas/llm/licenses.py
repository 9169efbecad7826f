"""Licence scan: sentences to identifiers, identifier sequences to ordered licence rules.

A text is cut into sentences, each is normalised (lower case, runs of anything but ASCII letters
and digits to one blank), and known licence sentences get their identifier by an equi-join with the
sentence table. The identifiers of a document, in order of their place, form a sequence, which
ordered rules are matched against. Only DataFrame functions are used.

A text is cut three ways, as notices stand on one line or are wrapped: at line breaks; with a single
line break as a blank; and so, but at a colon or semicolon too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ananas.llm.shared import ascii_lower, small_side, written

# Well-known licence sentences, and the rules as sequences of them.
SENTENCES = {
    1: "Licensed under the Apache License, Version 2.0.",
    2: "You may not use this file except in compliance with the License.",
    3: "You may obtain a copy of the License at",
    4: "Released under the MIT License.",
    5: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    6: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    7: "This work is licensed under the GNU General Public License, version 3.",
    8: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
    9: "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY.",
    10: "Licensed under CC BY-NC 4.0.",
    11: "Licensed under CC BY 4.0.",
    12: "Licensed under CC BY-SA 4.0.",
    13: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    14: "SPDX-License-Identifier: MIT",
    15: "SPDX-License-Identifier: Apache-2.0",
    16: "SPDX-License-Identifier: GPL-3.0-only",
    17: "All rights reserved.",
    # as the licences' own texts have them
    18: 'Licensed under the Apache License, Version 2.0 (the "License");',
    19: 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    20: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    21: "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
}
RULES = [
    ("Apache-2.0", [1]),
    ("Apache-2.0", [2, 3]),
    ("Apache-2.0", [15]),
    ("Apache-2.0", [18]),
    ("MIT", [4]),
    ("MIT", [5, 6]),
    ("MIT", [14]),
    ("MIT", [19, 6]),
    ("GPL-3.0", [7]),
    ("GPL-3.0", [8, 9]),
    ("GPL-3.0", [16]),
    ("GPL-3.0", [20]),
    ("CC-BY-NC-4.0", [10]),
    ("CC-BY-4.0", [11]),
    ("CC-BY-SA-4.0", [12]),
    ("BSD", [13]),
    ("proprietary", [17]),
]
#: Marks put into a text: \x01 for . ! ? before a blank, \x02 for a single line break, \x03 for a colon or semicolon
#: after a word, \x04 for a line without a letter or digit and after a copyright line; \x05 number \x06 stand before each piece between marks.
MARKS = [
    (r"\r\n?", "\n"),
    (r"(^|\n)[^A-Za-z0-9\n]+", "$1"),
    (r"((?<![^\n])(?:(?:[Cc]opyright|COPYRIGHT)[\x20\x09,:]*(?:\([Cc]\)|©|[0-9]{4})|[Cc]\)[\x20\x09]*[0-9]{4})[^\n]*)\n", "$1\x04"),
    (r"[.!?]+(?=[\x20\x09\n\x04])", "\x01"),
    (r"\n\n+", "\x04"),
    (r"\n", "\x02"),
    (r"(?<=[A-Za-z0-9)\"'])[:;](?=[\x20\x09\x02\x04])", "\x03"),
]
#: Where sentences end: by line; with wrapped lines rejoined; and at colons and semicolons too.
CUTS = ["[\x01\x02\x04]", "[\x01\x04]", "[\x01\x03\x04]"]
#: The number of the piece that has a sentence's first letter or digit.
FIRST = "\x05([0-9]+)\x06[^\x05A-Za-z0-9]*[A-Za-z0-9]"


def normalised(col: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(col), r"[^a-z0-9]+", " "))


def numbered(text: Column) -> Column:
    """``text`` with its ``MARKS``, and a number before each piece between them."""
    text = F.translate(text, "\x01\x02\x03\x04\x05\x06", "______")
    for pattern, mark in MARKS:
        text = F.regexp_replace(text, pattern, mark)
    return F.array_join(F.transform(F.split(text, "(?<=[\x01-\x04])"), lambda s, i: F.concat(F.lit("\x05"), i.cast("string"), F.lit("\x06"), s)), "")


def cut(text: Column, ends: str) -> Column:
    """Sentences of a numbered text that have a letter or digit: piece, norm."""
    told = F.transform(F.split(text, ends), lambda s: F.struct(s.alias("piece"), normalised(F.regexp_replace(s, "\x05[0-9]+\x06", " ")).alias("norm")))
    return F.filter(told, lambda x: x["norm"] != "")


def rule_pattern(ids: list[int]) -> str:
    """A rule as a pattern over ``,1,,5,,6,``: its identifiers in order, others may stand between."""
    return ".*".join(f",{i}," for i in ids)


def sentence_table(spark: SparkSession, sentences: dict[int, str]) -> DataFrame:
    t = spark.createDataFrame([(k, v) for k, v in sentences.items()], "sid int, sentence string")
    return t.select("sid", normalised(F.col("sentence")).alias("norm"))


def scan_licenses(docs: DataFrame, sentences: dict[int, str] | None = None, rules: list | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): n_sentences, n_known, sequence, licenses.

    ``n_sentences`` counts sentences with an ASCII letter or digit as cut at line breaks, ``n_known``
    those in the table by any of the three cuts (of two that start at one place the longer), ``sequence``
    has their identifiers in order of place (``,1,,4,``; empty if none), ``licenses`` the
    names of the rules that match, sorted, comma-joined and each once (empty if none). Null and empty
    texts have no sentences; repeated rows and repeated or null ids are scanned row by row; other
    columns are ignored.
    """
    sentences, rules = sentences or SENTENCES, rules or RULES
    spark = docs.sparkSession
    docs = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("row", "doc_id", numbered(F.col("text")).alias("text"))
    docs = docs.select("row", "doc_id", *(cut(F.col("text"), ends).alias(f"cut{k}") for k, ends in enumerate(CUTS)))
    known = sentence_table(spark, sentences).groupBy("norm").agg(F.min("sid").alias("sid"))
    # an entry that can't equal any sentence stands for the document itself
    table = small_side(written(known.union(spark.sql("select '\x01' as norm, 0 as sid")), "sentences"))
    # only sentences as long as one in the table can equal it
    sizes = [r["size"] for r in table.select(F.length("norm").alias("size")).distinct().collect()]
    told = F.filter(F.concat(*(f"cut{k}" for k in range(len(CUTS)))), lambda x: F.length(x["norm"]).isin(sizes))
    told = F.transform(told, lambda x: F.struct(F.regexp_extract(x["piece"], FIRST, 1).cast("int").alias("place"), x["norm"].alias("norm")))
    own = F.array(F.struct(F.lit(-1).alias("place"), F.lit("\x01").alias("norm")))
    rows = docs.select("row", "doc_id", F.size("cut0").cast("long").alias("n_sentences"), F.explode(F.concat(told, own)).alias("x"))
    rows = rows.select("row", "doc_id", "n_sentences", "x.place", "x.norm").join(table, "norm")
    agg = rows.groupBy("row").agg(
        F.first(F.when(F.col("sid") == 0, F.col("doc_id")), ignorenulls=True).alias("doc_id"),
        F.max("n_sentences").alias("n_sentences"),
        F.sort_array(F.collect_set(F.when(F.col("sid") > 0, F.struct("place", F.length("norm").alias("size"), "sid")))).alias("found"),
    )
    last = F.filter("found", lambda x, i: (i + 1 == F.size("found")) | (F.get("found", i + 1)["place"] != x["place"]))
    agg = agg.withColumn("found", last)
    sequence = F.array_join(F.transform("found", lambda x: F.concat(F.lit(","), x["sid"].cast("string"), F.lit(","))), "")
    agg = agg.select("doc_id", "n_sentences", F.size("found").cast("long").alias("n_known"), sequence.alias("sequence"))
    hit = [F.when(F.col("sequence").rlike(rule_pattern(ids)), F.lit(name)) for name, ids in rules]
    return agg.withColumn("licenses", F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*hit)))), ","))
