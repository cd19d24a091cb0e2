"""Licence scan: sparse TF-IDF cosine to templates, then inheritance by directory.

The sentences of a file that speak of a licence are its header.  Each is a
sparse TF-IDF vector (idf over the templates; a word in no template weighs
most), and its cosine to every template comes from one equi-join on words
with the fixed template table.  The best template at or above the threshold
is the file's own licence.  A paragraph near to a licence's text, title or standard
header, or an SPDX identifier, goes before where it is nearer.  A licence file (by name, or as the caller says)
licenses its directory; a file without an own licence takes that of the
nearest ancestor directory, found by joining paths.  Input columns with the
names of the results are replaced.

The text is read once: its sentences and paragraphs that may tell a licence are
written to the shared folder, and all cosines come from these.  Texts of more
licences can be given (`texts`).

Only DataFrame functions are used.  Files with a null path, null or empty
text, or no such sentence have no own licence; ties go to the template first
in the alphabet, and of several licence files in a directory the one with the
highest cosine counts, then the smallest path.  Repeated rows are kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from varloom.llm._shared import materialize, tidy, with_output, written

#: Short notices of public licences, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3",
    "BSD-3-Clause": "Released under the BSD 3-Clause License",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0",
    "GPL-2.0": "Licensed under the GNU General Public License, version 2",
    "GPL-3.0": "Licensed under the GNU General Public License, version 3",
    "ISC": "Released under the ISC License",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "Subject to the terms of the Mozilla Public License, version 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}
_GNU = "This {2} is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
#: Paragraphs of the licences' texts, their titles and standard headers.
TEXTS = [
    ("AGPL-3.0", _GNU.format("Affero ", 3, "program")),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("Apache-2.0", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("GPL-2.0", _GNU.format("", 2, "program")),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", _GNU.format("", 3, "program")),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", _GNU.format("Lesser ", 2.1, "library")),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", _GNU.format("Lesser ", 3, "library")),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
BODY = r"(?i)(?:permission|redistribution)[\s*#/;%-]+(?:is|to|and)[\s*#/;%-]+(?:hereby|use)|general[\s*#/;%-]+public[\s*#/;%-]+licen|apache[\s*#/;%-]+licen|mozilla[\s*#/;%-]+public|creative[\s*#/;%-]+commons|unencumbered|bsd[\s*#/;%-]+[23]-clause"
SPDX = r"SPDX-License-Identifier:[ \t]*(\(*[A-Za-z0-9][A-Za-z0-9.+-]*\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*[A-Za-z0-9][A-Za-z0-9.+-]*\)*)*)"
LEADER = r"(?m)^[ \t]*(?:/\*+|\*+/|\*+|//+|#+|;+|--+|%+|<!--)?[ \t]*|[ \t\r]*(?:\*+/|-->)?[ \t\r]*$"
ALIKE = 0.8  # least cosine of a paragraph to one of TEXTS
SPEAKS = r"(?i)licen[sc]e|copyright|public domain|spdx|\bCC0?[ -](?:BY|1\.0)"
SENTENCE = r"(?<=[.!?])\s+|[\r\n]+"
NAMES = r"(?i)^(licen[sc]e|copying|notice|unlicense)(\.[a-z]+)?$"
THRESHOLD = 0.6
_WORDS = r"[a-z0-9][a-z0-9.-]*[a-z0-9]|[a-z0-9]"


def text_table(spark: SparkSession, texts: list[tuple[str, str]]) -> tuple[DataFrame, float]:
    """(licence and number of the text, word, weight, idf), and the idf of a word in no text.  As long as the texts."""
    named = [*texts, ("BSD", _BSD)]
    bags = [Counter(re.findall(_WORDS, v.lower())) for _, v in named]
    df = Counter(w for b in bags for w in b)
    idf = {w: math.log((1 + len(bags)) / (1 + n)) + 1 for w, n in df.items()}
    rows = []
    for i, ((k, _), b) in enumerate(zip(named, bags, strict=True)):
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in b.items()))
        rows += [(k, i, w, n * idf[w] / norm, idf[w]) for w, n in b.items()]
    return spark.createDataFrame(rows, "licence string, text int, word string, weight double, idf double"), math.log(1 + len(bags)) + 1


def cosines(words: DataFrame, table: DataFrame, unknown: float) -> DataFrame:
    """_key, _at, _near: negative cosine and licence of every template that shares a word with the unit, nearest first.

    `words` has a row for each word of a unit (_key, _at).  The unit's own
    squared length is summed beside its products, as one more template.
    """
    terms = F.broadcast(table.groupBy("word").agg(F.first("idf").alias("idf"), F.collect_list(F.struct("licence", "text", "weight")).alias("_t")))  # as long as the templates
    bag = words.groupBy("_key", "_at", "word").agg(F.count(F.lit(1)).alias("_c"))
    weighed = bag.join(terms, "word", "left").withColumn("_w", F.col("_c") * F.coalesce("idf", F.lit(unknown)))
    own = F.struct(F.lit(None).cast("string").alias("licence"), F.lit(-1).alias("text"), F.col("_w").alias("weight"))
    each = weighed.select("_key", "_at", "_w", F.explode(F.concat(F.array(own), F.coalesce("_t", F.array().cast("array<struct<licence:string,text:int,weight:double>>")))).alias("_x"))
    sums = each.groupBy("_key", "_at", F.col("_x.licence").alias("licence"), F.col("_x.text").alias("text")).agg(F.sum(F.col("_x.weight") * F.col("_w")).alias("p"))
    per = sums.groupBy("_key", "_at").agg(F.max(F.when(F.col("text") < 0, F.col("p"))).alias("_sq"), F.collect_list(F.when(F.col("text") >= 0, F.struct("licence", "p"))).alias("_p"))
    scored = F.array_sort(F.transform("_p", lambda x: F.struct((-F.round(x["p"] / F.sqrt("_sq"), 9)).alias("neg"), x["licence"].alias("licence"))))
    return per.where(F.size("_p") > 0).select("_key", "_at", scored.alias("_near"))


def lines(files: DataFrame, key: str, text: str) -> DataFrame:
    """What may tell the licence of a file, from one scan of its text; written to the shared folder.

    _key, n_sentences, speaking (sentences that speak of a licence),
    paragraphs (that may be of a licence's text), three (a BSD text with its
    third clause), spdx (identifier or ""), spdx_lines.
    """
    t = F.col(f"`{text}`")
    sentences = F.split(t, SENTENCE)
    body, marked = t.rlike(BODY), t.contains("SPDX-License-Identifier:")
    none = F.array().cast("array<string>")
    paragraphs = F.filter(F.split(F.regexp_replace(t, LEADER, ""), r"\n\s*\n"), lambda p: p.rlike(BODY))
    said = files.where(t.rlike(f"{SPEAKS}|{BODY}")).select(
        F.col(key).alias("_key"),
        F.size(F.filter(sentences, lambda s: s != "")).alias("n_sentences"),
        F.filter(sentences, lambda s: s.rlike(SPEAKS)).alias("speaking"),
        F.when(body, paragraphs).otherwise(none).alias("paragraphs"),
        (body & t.rlike(r"(?i)neither[\s*#/;%-]+the[\s*#/;%-]+names?|names?[\s*#/;%-]+of[\s*#/;%-]+[^.]{1,200}may[\s*#/;%-]+not[\s*#/;%-]+be[\s*#/;%-]+used[\s*#/;%-]+to[\s*#/;%-]+endorse")).alias("three"),
        F.when(marked, F.regexp_extract(t, SPDX, 1)).otherwise("").alias("spdx"),
        F.when(marked, F.size(F.filter(sentences, lambda s: s.rlike(SPDX)))).otherwise(0).alias("spdx_lines"),
    )
    return materialize(said, "licence-lines")


def text_licence(said: DataFrame, texts: list[tuple[str, str]] = TEXTS) -> DataFrame:
    """_key, _text (cosine, licence, exact), _within: the licence whose text, title or standard header is a paragraph of the file.

    An SPDX identifier counts exactly and first.  `_within` is the number of
    sentences in such paragraphs.
    """
    table, unknown = text_table(said.sparkSession, texts)
    spdx = said.where("spdx <> ''").select("_key", F.struct(F.lit(-2.0).alias("neg"), F.col("spdx").alias("licence")).alias("_b"), F.col("spdx_lines").alias("_within"))
    each = said.select("_key", "three", F.posexplode("paragraphs").alias("_at", "_p"))
    words = each.select("_key", "_at", F.explode(F.regexp_extract_all(F.lower("_p"), F.lit(_WORDS), F.lit(0))).alias("word"))
    near = cosines(words, table, unknown).where(F.col("_near")[0]["neg"] <= -ALIKE)
    told = near.join(each.select("_key", "_at", "three", F.size(F.filter(F.split("_p", SENTENCE), lambda s: s != "")).alias("_n")).dropDuplicates(["_key", "_at"]), ["_key", "_at"])
    named = F.transform("_near", lambda x: F.struct(x["neg"].alias("neg"), F.when(x["licence"] != "BSD", x["licence"]).when(F.col("three"), "BSD-3-Clause").otherwise("BSD-2-Clause").alias("licence")))
    best = told.select("_key", F.array_min(named).alias("_b"), "_n").groupBy("_key").agg(F.min("_b").alias("_b"), F.sum("_n").cast("int").alias("_within"))
    return best.unionByName(spdx).groupBy("_key").agg(F.min("_b").alias("_b"), F.max("_within").alias("_within")).select("_key", F.struct(F.least(-F.col("_b.neg"), F.lit(1.0)).alias("cosine"), F.col("_b.licence").alias("licence"), (F.col("_b.neg") == -2.0).alias("exact")).alias("_text"), "_within")


def template_table(spark: SparkSession) -> tuple[DataFrame, float]:
    """(licence, word, weight, idf) with unit vectors, and the idf of a word in no template.  As long as the template list."""
    bags = {k: Counter(re.findall(_WORDS, v.lower())) for k, v in TEMPLATES.items()}
    df = Counter(w for b in bags.values() for w in b)
    idf = {w: math.log((1 + len(bags)) / (1 + n)) + 1 for w, n in df.items()}
    rows = []
    for k, b in bags.items():
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in b.items()))
        rows += [(k, w, n * idf[w] / norm, idf[w]) for w, n in b.items()]
    return spark.createDataFrame(rows, "licence string, word string, weight double, idf double"), math.log(1 + len(bags)) + 1


def own_licence(said: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """_key, own_licence, cosine, n_speaking of the files of which a sentence is near a notice."""
    table, unknown = template_table(said.sparkSession)
    one = said.where(F.size("speaking") > 0).select("_key", F.posexplode("speaking").alias("_at", "_sentence"))
    words = one.select("_key", "_at", F.explode(F.regexp_extract_all(F.lower("_sentence"), F.lit(_WORDS), F.lit(0))).alias("word"))
    best = cosines(words, table.withColumn("text", F.lit(0)), unknown).groupBy("_key").agg(F.min(F.col("_near")[0]).alias("_b")).where(F.col("_b.neg") <= -threshold)
    speaks = said.groupBy("_key").agg(F.max(F.size("speaking")).alias("n_speaking"))
    return best.join(speaks, "_key").select("_key", F.col("_b.licence").alias("own_licence"), (-F.col("_b.neg")).alias("cosine"), "n_speaking")


def licence_of(files: DataFrame, key: str, text: str = "text", threshold: float = THRESHOLD, texts: list[tuple[str, str]] = TEXTS) -> DataFrame:
    """key, own_licence (of the nearest notice, or of the text or identifier that the file holds where that is nearer), cosine, n_sentences, n_speaking; written once.

    Rows that repeat a key count together.
    """
    start = written()
    said = lines(files, key, text)
    both = own_licence(said, threshold).join(text_licence(said, texts), "_key", "full").join(said.groupBy("_key").agg(F.max("n_sentences").alias("n_sentences")), "_key")
    nearer = F.col("_text").isNotNull() & (F.col("own_licence").isNull() | F.col("_text.exact") | (F.col("_text.cosine") > F.col("cosine")))
    out = both.select(F.col("_key").alias(key), F.when(nearer, F.col("_text.licence")).otherwise(F.col("own_licence")).alias("own_licence"), F.when(nearer, F.col("_text.cosine")).otherwise(F.col("cosine")).alias("cosine"), "n_sentences", F.greatest("n_speaking", F.when(nearer, F.col("_within"))).alias("n_speaking"))
    found = materialize(out, "licences")
    tidy(start, found)
    return found


def parent(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.when(path.isNotNull(), F.lit("")))


def scan(files: DataFrame, path: str = "path", text: str = "text", *, licence_file: Column | None = None, threshold: float = THRESHOLD, texts: list[tuple[str, str]] = TEXTS) -> DataFrame:
    """Add own_licence, cosine, licence and inherited_from (the licensing directory, null if own or none).

    `licence_file` says which scanned files license their directory; it may
    use path, n_sentences and n_speaking.  By default the file's name says so.
    """
    added = ("own_licence", "cosine", "licence", "inherited_from")
    files = files.select(*[F.col(f"`{c}`") for c in files.columns if c.lower() not in added])
    p = F.col(f"`{path}`")
    tagged = files.withColumn("_varloom_file", F.xxhash64(p)).withColumn("_varloom_file", F.struct(F.col("_varloom_file"), p.alias("_path")))
    own = licence_of(tagged.where(p.isNotNull()).select("_varloom_file", F.col(f"`{text}`").alias("_text")), "_varloom_file", "_text", threshold, texts)
    # Repeated paths count together: their best sentence speaks for each.
    narrow = tagged.drop(text).join(own, "_varloom_file", "left").withColumn("_varloom_dir", parent(p))
    name = F.regexp_extract(F.col("_varloom_file._path"), r"[^/]*$", 0)
    gives = own.where(name.rlike(NAMES) if licence_file is None else licence_file)
    given = gives.groupBy(parent(F.col("_varloom_file._path")).alias("_at")).agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("_varloom_file._path").alias("f"), F.col("own_licence").alias("l")))["l"].alias("_given"))
    # Nearest licensing ancestor of each distinct directory.
    dirs = narrow.where(F.col("_varloom_dir").isNotNull()).select("_varloom_dir").distinct()
    parts = F.split("_varloom_dir", "/")
    ups = dirs.select("_varloom_dir", F.explode(F.concat(F.array(F.lit("")), F.when(F.col("_varloom_dir") != "", F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>")))).alias("_at"))
    near = ups.join(given, "_at").groupBy("_varloom_dir").agg(F.max_by(F.struct("_at", "_given"), F.length("_at")).alias("_near"))
    out = narrow.join(near, "_varloom_dir", "left")
    inherits = F.col("own_licence").isNull() & F.col("_near").isNotNull()
    return with_output(out.drop("n_sentences", "n_speaking", "_varloom_file", "_varloom_dir"), licence=F.coalesce("own_licence", "_near._given"), inherited_from=F.when(inherits, F.col("_near._at"))).drop("_near")
