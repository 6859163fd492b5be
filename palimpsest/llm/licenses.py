"""License scans by a positional index of rare words.

Every template is a run of words with a mandatory key phrase inside. Its words' document frequencies over all documents say
which are rare. A file is looked up by its highest-IDF licence words: for each template the two rarest words of the key phrase.
Their places in the file, each moved back by the word's place in the template, must agree; there the key phrase is verified
word by word, and the rest of the template scores by the share of its words that stand where they should.

Every place of a key phrase holds both rare words at the right distance, so no place is missed. Null and empty texts have no
words; every row of the input gives one row; extra columns are ignored; an empty table gives an empty result.
Only built-in functions run on the executors.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize, with_columns, words_lower

#: (label, base, template, key phrase). The three base phrases are their own templates.
TEMPLATES = [
    ("mit", True, "under the mit license", "under the mit license"),
    ("apache-2", True, "apache license version 2", "apache license version 2"),
    ("cc-by-nc", True, "cc by nc", "cc by nc"),
    ("mit", False, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("apache-2", False, "licensed under the apache license version 2 0", "licensed under the apache license"),
    ("gpl-3", False, "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", False, "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", False, "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl-3", False, "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("mpl-2", False, "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("bsd", False, "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("isc", False, "permission to use copy modify and or distribute this software for any purpose with or without fee", "and or distribute this software for any purpose"),
    ("cc-by-nc", False, "creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc-by-sa", False, "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-sa", False, "creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc0", False, "creative commons zero v1 0 universal", "creative commons zero"),
    ("unlicense", False, "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
]
#: Longer ones: notices and grants as they stand in files, with the phrase that each must have.
NOTICES = [
    ("mit", False, """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
        and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
        IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
        THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", "shall be included in all copies or substantial portions of the software"),
    ("apache-2", False, """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""", "you may not use this file except in compliance with the license"),
    ("gpl-3", False, """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License,
        or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
        See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.""", "either version 3 of the license"),
    ("gpl-2", False, """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License,
        or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""", "either version 2 of the license"),
    ("bsd", False, """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
        "redistributions of source code must retain the above copyright notice"),
    ("isc", False, """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""", "and this permission notice appear in all copies"),
    ("mpl-2", False, """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
        "source code form is subject to the terms of the mozilla public license"),
    ("unlicense", False, """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
        for any purpose, commercial or non-commercial, and by any means.""", "anyone is free to copy modify publish use compile sell or distribute this software"),
]
#: Templates that a scan takes at most: their index is sent to every task.
MOST = 10_000
#: Least share of a template's words that must stand in place, besides the key phrase.
COVER = 0.5

_words = lambda s: re.findall(r"[a-z0-9]+", s.lower())


def read_templates(table: DataFrame) -> list[tuple]:
    """Templates of a table (label, body, phrase), to be given to ``scan``. More than MOST are an error, as is a phrase that its body lacks."""
    rows = table.select("label", "body", "phrase").distinct().limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} templates")
    return [(r.label, False, r.body, r.phrase) for r in rows]


def all_templates(given: list[tuple]) -> list[tuple]:
    """(number, label, base, words, words of the phrase, place of the phrase among the words) of each template."""
    out = []
    for number, (label, base, body, key) in enumerate(given):
        words, phrase = _words(body), _words(key)
        at = next((i for i in range(len(words)) if phrase and words[i : i + len(phrase)] == phrase), None)
        if at is None:
            raise ValueError(f"template {label}: its body lacks its phrase")
        out.append((number, label, base, words, phrase, at))
    return out


def scan(docs: DataFrame, with_base: bool = True, templates: list[tuple] | None = None) -> DataFrame:
    """uid, doc_id, n_words, and hits: array of (label, base, start of the key phrase, score), distinct. ``templates`` (label, False,
    body, phrase) take the place of the module's own; the base phrases stay unless ``with_base`` is false."""
    spark = docs.sparkSession
    own = TEMPLATES + NOTICES
    given = own if templates is None else [t for t in own if t[1]] + list(templates)
    chosen = [t for t in all_templates(given) if with_base or not t[2]]
    vocabulary = sorted({w for t in chosen for w in t[4]})
    words = F.regexp_extract_all(words_lower(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0))
    rows = with_columns(docs, ("doc_id", "long"), ("text", "string")).select("doc_id", words.alias("words"))
    rows = rows.withColumn("known", F.array_intersect("words", F.array(*map(F.lit, vocabulary))))
    # a file that lacks a word of every key phrase can't match any template: only the others keep their words
    able = F.lit(False)
    for phrase in {tuple(sorted(set(t[4]))) for t in chosen}:
        able = able | (F.size(F.array_intersect("known", F.array(*map(F.lit, phrase)))) == len(phrase))
    files = materialize(
        rows.select(
            "doc_id", F.monotonically_increasing_id().alias("uid"), F.size("words").cast("long").alias("n_words"), "known", F.when(able, F.col("words")).alias("words")
        )
    )

    # document frequency of the licence words over all files: as many rows as the templates have words
    seen = {r.word: r["count"] for r in files.select(F.explode("known").alias("word")).groupBy("word").count().collect()}
    index = spark.createDataFrame([_posting(t, seen) for t in chosen], "rarest string, offset1 int, second string, offset2 int, label string, base boolean, template array<string>, phrase array<string>, at int")

    candidates = files.filter(F.col("words").isNotNull())
    looked_up = candidates.select("uid", "words", F.explode("known").alias("rarest")).join(F.broadcast(index), "rarest")
    first = _places("words", F.col("rarest"), F.col("offset1"))
    both = F.when(F.array_contains("words", F.col("second")), F.array_intersect(first, _places("words", F.col("second"), F.col("offset2"))))
    n = F.size("phrase")
    verified = F.filter("starts", lambda s: (s >= 0) & (s + n <= F.size("words")) & (F.slice("words", s + 1, n) == F.col("phrase")))

    def hit(s: Column) -> Column:
        begin = s - F.col("at")
        aligned = F.filter(F.sequence(F.lit(0), F.size("template") - 1), lambda i: (begin + i >= 0) & (F.get("words", begin + i) == F.get("template", i)))
        return F.struct(F.col("label").alias("label"), F.col("base").alias("base"), s.alias("start"), F.round(F.size(aligned) / F.size("template"), 6).alias("score"))

    hits = looked_up.withColumn("starts", both).withColumn("verified", verified).filter(F.size("verified") > 0)
    hits = hits.select("uid", F.filter(F.transform("verified", hit), lambda h: h["score"] >= COVER).alias("hits"))
    grouped = hits.groupBy("uid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"))
    return files.select("uid", "doc_id", "n_words").join(grouped, "uid", "left")


def _places(words: str, word: Column, offset: Column) -> Column:
    return F.transform(F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i) == word), lambda i: i - offset)


def _posting(t: tuple, seen: dict[str, int]) -> tuple:
    """The template's row in the index: the two rarest words of its key phrase, each with its first place there."""
    _, label, base, words, phrase, at = t
    order = sorted(dict.fromkeys(phrase), key=lambda w: (seen.get(w, 0), w))
    first, second = order[0], order[min(1, len(order) - 1)]
    return first, phrase.index(first), second, phrase.index(second), label, base, words, phrase, at


def digest_columns(scanned: DataFrame) -> DataFrame:
    """One row per file: word count, base places, labels and the best score."""
    hits = F.coalesce("hits", F.array().cast("array<struct<label:string,base:boolean,start:int,score:double>>"))
    base = F.filter("h", lambda x: x["base"])
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: x["label"]))), ",")
    starts = F.transform("b", lambda x: x["start"])
    return scanned.withColumn("h", hits).withColumn("b", base).select(
        "doc_id",
        "n_words",
        F.size("b").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        labels("b").alias("base_labels"),
        labels("h").alias("labels"),
        F.coalesce(F.array_max(F.transform("h", lambda x: x["score"])), F.lit(0.0)).alias("score"),
    )
