"""License scans by diagonal voting, in DataFrame functions only.

All rolling word pairs of all texts are hashed and joined with the pairs of the license templates: notices and whole
license texts. A pair at word i of a text that stands at word j of a template votes for the diagonal i - j, where the
template would start. Votes are aggregated by diagonal, and neighbouring diagonals of a template merge (a word more or
less shifts the diagonal by one): those from a start diagonal on up to the template's drift, a quarter of its words, at
least 1 and at most ``DRIFT``. So a span is never longer than its template and the drift. It is verified by aligning: the
longest run of votes that rises in the text and in the template must hold the share ``least`` of the template's pairs. Of
starts that lie within the drift of each other, the best one is the span. The template table has a fixed number of rows
(see TEMPLATES and TEXTS), so it is broadcast.

Defined cases: null text counts as empty; texts without words get n_words 0 and no labels; a very long text is split once
and its pairs are rows; repeated rows each get a row; null doc_id is an id like any other; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

# Base phrases with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Longer notices with the method's own labels.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-notice",
    "this work is licensed under the gnu general public license version 3": "gpl-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-header",
    "licensed under cc by nc 4 0": "cc-notice",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-attribution",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-grant",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-grant",
}
# License texts and headers, as published; gpl-text and apache-header are headers, bsd-text and isc-text begin their texts.
TEXTS = {
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE
SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "bsd-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list
of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission.""",
    "apache-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    "gpl-text": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details. You should have received a copy of the GNU General Public License along with this program.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
}
DRIFT = 8
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_words(docs: DataFrame) -> DataFrame:
    """Adds parts, lead and n_words: the text split at its gaps, in its own case, word i being parts[lead + i].

    A gap holds A-Z as little as it holds a-z, so lower-casing would not move a border. A gap at either end of the text
    leaves an empty part there.
    """
    parts = docs.withColumn("parts", F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), GAP))
    empty = lambda i: (F.element_at("parts", i) == "").cast("int")
    return parts.withColumn("lead", empty(1)).withColumn("n_words", F.greatest(F.size("parts") - F.col("lead") - empty(-1), F.lit(0)))


def templates() -> list[tuple[str, list[str]]]:
    """The method's own labels with the words of their templates."""
    return [(label, phrase.split()) for phrase, label in TEMPLATES.items()] + [(label, [w for w in re.split(GAP, text.lower()) if w]) for label, text in TEXTS.items()]


def template_pairs(spark: SparkSession) -> DataFrame:
    rows = []
    for base, group in ((True, [(label, phrase.split()) for phrase, label in BASE.items()]), (False, templates())):
        for label, w in group:
            rows += [(label, base, len(w), len(w) - 1, j, a, b) for j, (a, b) in enumerate(zip(w, w[1:]))]
    pairs = spark.createDataFrame(rows, "label string, base boolean, t_words int, t_pairs int, t_at int, t_a string, t_b string")
    return pairs.withColumn("t_hash", F.xxhash64("t_a", "t_b"))


def pair_hits(docs: DataFrame) -> DataFrame:
    """One row per row of docs (at -1, no label) and per place where a word pair of a text is one of a template."""
    small = lambda c: F.translate(c, UPPER, LOWER)
    word = lambda i: F.when(F.col("at") >= 0, F.get("parts", F.col("lead") + F.col("at") + i))
    exploded = (
        split_words(docs.select("doc_id", "key", "text"))
        .select("doc_id", "key", "parts", "lead", "n_words", F.explode(F.sequence(F.lit(-1), F.greatest(F.col("n_words") - 2, F.lit(-1)))).alias("at"))
        .select("doc_id", "key", "n_words", "at", word(0).alias("a"), word(1).alias("b"))
        .withColumn("hash", F.when(F.col("at") >= 0, F.xxhash64(F.lower("a"), F.lower("b"))))
    )
    pairs = F.broadcast(template_pairs(docs.sparkSession))
    same = (F.col("hash") == F.col("t_hash")) & (small(F.col("a")) == F.col("t_a")) & (small(F.col("b")) == F.col("t_b"))
    hits = exploded.join(pairs, same, "left").where((F.col("at") < 0) | F.col("label").isNotNull())
    return hits.select("doc_id", "key", "n_words", "at", "label", "base", "t_words", "t_pairs", "t_at")


def longest_rise(values: Column) -> Column:
    """The length of the longest strictly rising subsequence of an array, by the least last value of each length."""
    below = lambda a, x: F.filter(a, lambda y: y < x)
    put = lambda a, x: F.concat(below(a, x), F.array(x), F.slice(a, F.size(below(a, x)) + 2, F.size(a)))
    return F.size(F.aggregate(values, F.expr("cast(array() as array<int>)"), put))


def spans(hits: DataFrame, drift: int = DRIFT, least: float = 0.75) -> DataFrame:
    """Verified spans of pair_hits(): doc_id, key, label, base, start, end (words, end exclusive), coverage.

    Base phrases stand where all their pairs lie on one diagonal. The other templates merge the diagonals within their
    drift and need the share ``least`` of their pairs, aligned.
    """
    per_diagonal = (
        hits.where("label is not null")
        .groupBy("doc_id", "key", "label", "base", "t_words", "t_pairs", (F.col("at") - F.col("t_at")).alias("diagonal"))
        .agg(F.collect_set("t_at").alias("seen"))
    )
    base = per_diagonal.where(F.col("base") & (F.size("seen") == F.col("t_pairs"))).select(
        "doc_id", "key", "label", "base", F.col("diagonal").cast("long").alias("start"),
        (F.col("diagonal") + F.col("t_words")).cast("long").alias("end"), F.lit(1.0).alias("coverage"),
    )
    line = Window.partitionBy("doc_id", "key", "label").orderBy("diagonal")
    own_drift = F.least(F.greatest(F.floor(F.col("t_words") / 4), F.lit(1)), F.lit(drift))
    near = F.filter("ahead", lambda d: d["diagonal"] - F.col("diagonal") <= own_drift)
    votes = F.flatten(F.transform(near, lambda d: F.transform(d["seen"], lambda t: F.struct((t + d["diagonal"]).alias("at"), (-t).alias("down")))))
    starts = (
        per_diagonal.where(~F.col("base"))
        .withColumn("ahead", F.collect_list(F.struct("diagonal", "seen")).over(line.rangeBetween(0, drift)))
        .where(F.size(F.array_distinct(F.flatten(F.transform(near, lambda d: d["seen"])))) >= F.col("t_pairs") * least)
        .withColumn("votes", F.array_sort(votes))
        .withColumn("coverage", longest_rise(F.transform("votes", lambda v: -v["down"])) / F.col("t_pairs"))
        .where(F.col("coverage") >= least)
        .select("doc_id", "key", "label", "base", "diagonal", "coverage", F.element_at("votes", 1)["at"].alias("lo"), F.element_at("votes", -1)["at"].alias("hi"))
    )
    best = F.max_by(F.struct("coverage", "lo", "hi"), F.struct("coverage", (-F.col("diagonal")).alias("first")))
    merged = (
        starts.withColumn("new", (F.coalesce(F.col("diagonal") - F.lag("diagonal").over(line), F.lit(drift + 1)) > drift).cast("int"))
        .withColumn("run", F.sum("new").over(line))
        .groupBy("doc_id", "key", "label", "base", "run")
        .agg(best.alias("b"))
        .select("doc_id", "key", "label", "base", F.col("b.lo").cast("long").alias("start"), (F.col("b.hi") + 2).cast("long").alias("end"), F.col("b.coverage").alias("coverage"))
    )
    return base.unionByName(merged)


def scan_licenses(docs: DataFrame, drift: int = DRIFT, least: float = 0.75) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the best coverage among the spans (1 for a base phrase), 0 without any. Rows alike in id and text share
    one scan, whose spans are told apart by a hash of the text.
    """
    keyed = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    hits = written(pair_hits(keyed), "license-hits")
    found = spans(hits, drift, least)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    is_base = F.col("base")
    per_doc = found.groupBy("doc_id", "key").agg(
        F.sum(is_base.cast("long")).alias("n_base"),
        F.min(F.when(is_base, F.col("start"))).alias("first_word"),
        F.max(F.when(is_base, F.col("start"))).alias("last_word"),
        joined(F.when(is_base, F.col("label"))).alias("base_labels"),
        joined("label").alias("labels"),
        F.max("coverage").alias("score"),
    )
    counted = hits.where("at < 0").select("doc_id", "key", F.col("n_words").cast("long").alias("n_words"))
    p = per_doc.withColumnRenamed("doc_id", "p_id").withColumnRenamed("key", "p_key")
    return counted.join(p, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("key") == F.col("p_key")), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
