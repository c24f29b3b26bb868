"""Licence scans by diagonal voting, in DataFrame operations only.

All rolling word k-grams of a text are joined, by hash and then by their words, to positions in licence templates. A match votes for its
diagonal (position in the text less position in the template). Votes are added up per diagonal as a bit set of template positions, in as
many longs as the longest template needs;
neighbouring diagonals (words put in or left out) are merged, and a merged span is verified: enough of the template's k-grams, in a span
of bounded length. A base phrase stands where one diagonal has all its k-grams. The templates, a fixed list, are broadcast.

Defined cases: null and empty texts have no words; templates have k words or more, without upper limit; repeated rows repeat their result (rows are told apart by their
place in the table, so the input is to be a table, which reads alike each time); other columns play no part.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 3
#: Diagonals this close are one span; a span is at most so many times as long as its template; share of a long template's k-grams that verifies it.
SLACK, STRETCH, SHARE, LONG = 2, 2, 0.7, 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Base phrases: their places are counted exactly.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Wordings of well-known licences and of references to them.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl", "gnu general public license"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl-3", "gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "creative commons attribution 4 0 international"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc0", "creative commons zero"),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software
        without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
        or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
        WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code
        must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list
        of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of
        its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS
        AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
        LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
        STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
        notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
        AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
        acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as
        being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    ),
)
#: Stands before the k-grams of each text, so that every text has a row after the join.
MARK = "\u0001"


#: Template positions in one long of votes.
VOTES = 64


def template_rows(wordings: tuple[tuple[str, str], ...] = TEMPLATES) -> list[tuple[int, str, bool, int, int, int, int, str]]:
    """template, label, base, words, grams, grams needed, position, k-gram: of the base phrases and other wordings (label, text)."""
    rows = [(-1, "", False, 0, 0, 1, 0, MARK)]
    for t, (label, text) in enumerate([*BASE, *wordings]):
        words = [w for w in re.split(SEPARATORS, re.sub("[A-Z]+", lambda m: m[0].lower(), text)) if w]
        n = len(words) - K + 1
        if n < 1:
            raise ValueError(f"a wording needs {K} words: {text!r}")
        need = n if len(words) < LONG else math.ceil(SHARE * n)
        rows += [(t, label, t < len(BASE), len(words), n, need, i, " ".join(words[i : i + K])) for i in range(n)]
    return rows


def template_values(rows: list[tuple]) -> str:
    quoted = lambda label: label.replace("'", "''")
    return ", ".join(f"({t}, '{quoted(label)}', {base}, {words}, {n}, {need}, {i}, '{gram}')" for t, label, base, words, n, need, i, gram in rows)


def templates(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.sql(f"SELECT *, xxhash64(tgram) AS thash FROM VALUES {template_values(rows)} AS t(template, label, base, words, grams, need, tpos, tgram)")


def words_of(text: Column) -> Column:
    # lower() also lower-cases other letters. None of them becomes an ASCII letter but the Kelvin sign, which is made another letter first.
    lowered = F.lower(F.replace(text, F.lit("K"), F.lit("é")))
    return F.coalesce(F.array_remove(F.split(lowered, SEPARATORS), ""), F.array().cast("array<string>"))


def scan_licenses(docs: DataFrame, wordings: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row for each row of docs (doc_id, text). wordings (label, text): beside the base phrases."""
    listed = template_rows(wordings)
    longs = range(max(r[4] for r in listed) // VOTES + 1)
    worded = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words_of(F.col("text")).alias("doc_words"))
    grams = F.transform("doc_words", lambda w, i: F.concat_ws(" ", w, *(F.get("doc_words", i + j) for j in range(1, K))))
    rolled = worded.select("doc_id", "row", F.size("doc_words").cast("long").alias("n_words"), F.posexplode(F.concat(F.array(F.lit(MARK)), grams)).alias("pos", "gram")).withColumn("hash", F.xxhash64("gram"))
    t = F.broadcast(templates(docs.sparkSession, listed))
    voted = rolled.join(t, (rolled["hash"] == t["thash"]) & (rolled["gram"] == t["tgram"]))
    vote = lambda k: F.when(F.call_function("div", F.col("tpos"), F.lit(VOTES)) == k, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("tpos") % VOTES))
    total = lambda of: sum((F.bit_count(of(f"votes{k}")) for k in longs[1:]), F.bit_count(of("votes0")))
    whole = F.col("base") & (F.col("n_votes") == F.col("grams"))
    # One shuffle: all that follows groups by row, or by row and more.
    diagonals = (
        voted.select("doc_id", "row", "n_words", "template", "label", "base", "words", "grams", "need", "tpos", (F.col("pos") - 1 - F.col("tpos")).alias("diagonal"))
        .repartition("row")
        .groupBy("row", "template", "diagonal")
        .agg(F.first("doc_id").alias("doc_id"), *(F.max(c).alias(c) for c in ("n_words", "label", "base", "words", "grams", "need")), *(F.coalesce(F.bit_or(vote(k)), F.lit(0).cast("long")).alias(f"votes{k}") for k in longs), F.min("tpos").alias("low"), F.max("tpos").alias("high"))
        .withColumn("n_votes", total(F.col))
    )
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > SLACK).cast("int"), F.lit(0))
    spans = (
        diagonals.withColumn("apart", apart)
        .withColumn("span", F.sum("apart").over(by))
        .groupBy("row", "template", "span")
        .agg(
            F.first("doc_id").alias("doc_id"),
            *(F.max(c).alias(c) for c in ("n_words", "label", "base", "words", "grams", "need")),
            total(F.bit_or).alias("merged"),
            F.max("n_votes").alias("single"),
            (F.max(F.col("diagonal") + F.col("high")) + K - F.min(F.col("diagonal") + F.col("low"))).alias("length"),
            F.count_if(whole).alias("places"),
            F.min(F.when(whole, F.col("diagonal"))).alias("first_word"),
            F.max(F.when(whole, F.col("diagonal"))).alias("last_word"),
        )
    )
    enough = (F.col("single") >= F.col("need")) | ((F.col("merged") >= F.col("need")) & (F.col("length") <= STRETCH * F.col("words")))
    verified = F.when(F.col("template") < 0, False).when(F.col("base"), F.col("places") > 0).otherwise(enough)
    label = lambda when: F.concat_ws(",", F.array_sort(F.collect_set(F.when(when, F.col("label")))))
    return (
        spans.withColumn("verified", verified)
        .groupBy("row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.max("n_words").alias("n_words"),
            F.sum("places").alias("n_base"),
            F.min("first_word").cast("long").alias("first_word"),
            F.max("last_word").cast("long").alias("last_word"),
            label(F.col("places") > 0).alias("base_labels"),
            label(F.col("verified")).alias("labels"),
            F.coalesce(F.max(F.when(F.col("verified"), F.greatest("single", "merged") / F.col("grams"))), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )


LICENSES_SQL = rf"""
WITH t(template, label, base, words, grams, need, tpos, tgram) AS (VALUES {template_values(template_rows()[1:])}),
d AS (
  SELECT doc_id, row_number() OVER () AS r,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), g AS (SELECT r, i - 1 AS pos, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
diagonals AS (
  SELECT r, template, label, base, words, grams, need, pos - tpos AS diagonal, count(DISTINCT tpos) AS n, list(DISTINCT tpos) AS votes, min(tpos) AS low, max(tpos) AS high
  FROM g JOIN t ON gram = tgram GROUP BY ALL
), marked AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER w > {SLACK} THEN 1 ELSE 0 END AS apart FROM diagonals WINDOW w AS (PARTITION BY r, template ORDER BY diagonal)),
numbered AS (SELECT *, sum(apart) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM marked),
spans AS (
  SELECT r, template, label, base, words, grams, need, len(list_distinct(flatten(list(votes)))) AS merged, max(n) AS single, max(diagonal + high) + {K} - min(diagonal + low) AS length,
         count(*) FILTER (base AND n = grams) AS places, min(diagonal) FILTER (base AND n = grams) AS first_word, max(diagonal) FILTER (base AND n = grams) AS last_word
  FROM numbered GROUP BY r, template, label, base, words, grams, need, span
), judged AS (SELECT *, CASE WHEN base THEN places > 0 ELSE single >= need OR (merged >= need AND length <= {STRETCH} * words) END AS verified FROM spans),
found AS (
  SELECT r, sum(places) AS n_base, min(first_word) AS first_word, max(last_word) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (places > 0) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (verified) AS labels,
         max(CASE WHEN verified THEN greatest(single, merged) / grams END) AS score
  FROM judged GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN found USING (r)
"""
