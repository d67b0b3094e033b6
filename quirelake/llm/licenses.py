"""License scans by diagonal voting. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, cut_small, fold_ascii, whole
from .decontam import gram_hashes, words

#: Words of a gram; diagonals of one place are so many words apart at most; share of a template's words that is reported, and that gives its label.
GRAM, SLACK, REPORTED, LABELLED = 4, 8, 0.3, 0.6

#: (label, phrase): a place is where the words stand, one after the other. Fixed values.
PHRASES = [("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license")]

#: (label, text): the notices that these licenses ask to be put into works.
NOTICES = [
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]


def template_table(spark: SparkSession, phrases: list[tuple[str, str]], notices: list[tuple[str, str]]) -> DataFrame:
    """(template, label, base, w, k): the templates' words, and how many a gram has."""
    rows = [(i, label, base, text) for i, (label, text, base) in enumerate([*((*p, True) for p in phrases), *((*n, False) for n in notices)])]
    t = spark.createDataFrame(rows, "template int, label string, base boolean, text string")
    return t.select("template", "label", "base", words(fold_ascii(whole(F.col("text")))).alias("w")).filter(F.size("w") > 0).withColumn("k", F.least(F.size("w"), F.lit(GRAM)))


def diagonal_votes(texts: DataFrame, templates: DataFrame, sizes: list[int]) -> DataFrame:
    """(k, t, template, diag, ats): in each text, the offsets from which template grams stand in it, with the grams' positions in the template.

    All rolling grams of all words are joined to the templates' by hash, where the texts lie; what is shuffled are hits."""
    found = None
    w = texts.select("k", "t", words(F.lower(F.col("text"))).alias("w"))
    for n in sizes:
        own = templates.filter(F.col("k") == n).select("template", F.posexplode(gram_hashes(F.col("w"), n)).alias("at", "h"))
        grams = w.select("k", "t", F.posexplode(gram_hashes(F.col("w"), n)).alias("pos", "h"))
        hits = grams.join(cut_small(own, "templates"), "h").select("k", "t", "template", (F.col("pos") - F.col("at")).alias("diag"), "at")
        found = hits if found is None else found.unionByName(hits)
    return found.groupBy("k", "t", "template", "diag").agg(F.collect_set("at").alias("ats"))  # at most a template's grams


def places(votes: DataFrame, templates: DataFrame, slack: int, reported: float) -> DataFrame:
    """(k, t, spans): for each text the places (template, n, lines: [(diag, ats)]) that may hold a template.

    Neighbouring diagonals of a notice, up to `slack` words apart, are one place: words were put in or left out between them. A place stays
    if the grams that voted for it cover `reported` of the template's words. A phrase's places are not merged: each has one gram."""
    size = templates.select("template", "base", "k", F.size("w").alias("n"))
    size = F.broadcast(size.withColumnRenamed("k", "gram"))  # a row for each template
    own = Window.partitionBy("k", "t", "template").orderBy("diag")
    rows = votes.join(size, "template").withColumn("fresh", F.col("base") | F.coalesce(F.col("diag") - F.lag("diag").over(own) > slack, F.lit(True)))
    rows = rows.withColumn("place", F.count_if("fresh").over(own))
    merged = rows.groupBy("k", "t", "template", "n", "gram", "place").agg(F.collect_list(F.struct("diag", "ats")).alias("lines"))
    merged = merged.filter(F.size(covered(F.col("lines"), F.col("gram"))) >= reported * F.col("n"))
    return merged.groupBy("k", "t").agg(F.collect_list(F.struct("template", "n", "gram", "lines")).alias("spans"))


def covered(lines: Column, gram: Column) -> Column:
    """The distinct template positions that the grams of a place cover."""
    return F.array_distinct(F.flatten(F.transform(lines, lambda x: F.flatten(F.transform(x["ats"], lambda a: F.sequence(a, a + gram - 1))))))


def verified(w: Column, own: Column, span: Column) -> Column:
    """How many of a template's words (own) stand at a place of a text's words (w): of the grams that voted, those whose words are equal one by one."""
    same = lambda d: lambda a: F.slice(w, d + a + 1, span["gram"]) == F.slice(own, a + 1, span["gram"])
    lines = F.transform(span["lines"], lambda x: F.struct(x["diag"].alias("diag"), F.filter(x["ats"], same(x["diag"])).alias("ats")))
    return F.size(covered(lines, span["gram"]))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: list[tuple[str, str]] | None = None, notices: list[tuple[str, str]] | None = None, slack: int = SLACK, reported: float = REPORTED, labelled: float = LABELLED) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Templates are phrases (base) and notices. Every run of GRAM words (of all, in shorter templates) of a text votes for the offset at which a template that
    has it would start; neighbouring offsets are one place; places are verified word by word. n_base counts the places of phrases, first_word and last_word are
    the least and largest word at which one starts (null without any), base_labels are their labels. labels also has those of notices of which a place holds
    `labelled` of the words. score is the largest share of a template's words at one place: 1 for phrases, 0 below `reported`. Labels are distinct, sorted,
    comma-joined, empty without any.
    Null and empty texts have no words. Repeated rows each give a row. Without templates, or on an empty table, there is nothing to find. Other
    columns are ignored, whatever their names. Only hits, and the texts that have places, are shuffled.
    """
    spark = docs.sparkSession
    table = cut(template_table(spark, PHRASES if phrases is None else phrases, NOTICES if notices is None else notices), "templates")
    listed = table.orderBy("template").collect()  # the templates given
    # What is found depends on a text alone, so (k, t) names it: k spreads equal hashes, t is the text's hash.
    number = docs.schema[id_col].dataType.typeName() in ("long", "integer", "short", "byte")
    k = F.coalesce(F.col(id_col).cast("long"), F.lit(0)) if number else F.xxhash64(id_col)
    base = docs.select(F.col(id_col).alias("id"), k.alias("k"), F.xxhash64(text_col).alias("t"), whole(F.col(text_col)).alias("text"))
    counted = base.select("id", "k", "t", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = [F.col("id").alias(id_col), "n_words", *[F.coalesce(F.col(f"f.{c}"), F.lit(v)).alias(c) for c, v in (("n_base", 0),)], "f.first_word", "f.last_word", *[F.coalesce(F.col(f"f.{c}"), F.lit(v)).alias(c) for c, v in (("base_labels", ""), ("labels", ""), ("score", 0.0))]]
    none = "struct<n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double>"
    if not listed:
        return counted.withColumn("f", F.lit(None).cast(none)).select(*out)
    some = cut(places(diagonal_votes(base, table, sorted({r.k for r in listed})), table, slack, reported), "places")
    keys = cut_small(some.select("k", "t"), "keys")
    texts = base.join(keys, ["k", "t"], "left_semi").select("k", "t", "text").dropDuplicates(["k", "t"]).join(some, ["k", "t"])
    own = F.array(*[F.array(*map(F.lit, r.w)) for r in listed])
    nth = {r.template: i for i, r in enumerate(listed)}
    of = F.element_at(F.create_map(*[F.lit(x) for p in nth.items() for x in p]), F.col("x.template"))
    checked = texts.select("k", "t", words(fold_ascii(F.col("text"))).alias("w"), "spans").select("k", "t", "w", F.explode("spans").alias("x"))
    checked = checked.withColumn("own", F.get(own, of)).select("k", "t", "x.template", F.get("x.lines", F.lit(0))["diag"].alias("start"), (verified(F.col("w"), F.col("own"), F.col("x")) / F.size("own")).alias("share"))
    kinds = F.broadcast(table.select("template", "label", "base"))  # a row for each template
    marks = checked.join(kinds, "template").filter((F.col("share") >= reported) & (~F.col("base") | (F.col("share") == 1)))
    start, names = F.when(F.col("base"), F.col("start").cast("long")), lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    marks = marks.groupBy("k", "t").agg(F.struct(F.count_if("base").alias("n_base"), F.min(start).alias("first_word"), F.max(start).alias("last_word"), names(F.when(F.col("base"), F.col("label"))).alias("base_labels"), names(F.when(F.col("share") >= labelled, F.col("label"))).alias("labels"), F.round(F.max("share"), 4).alias("score")).alias("f"))
    return counted.join(cut_small(marks, "licenses"), ["k", "t"], "left").select(*out)
