"""License scan over a positional index of rare licence words.

One pass over the texts keeps, for each file, the places of licence words (a fixed
vocabulary from the templates, function words left out).  Everything after it works
on that compact table.  Document frequencies over all files give each word its IDF.
A template is indexed by its highest-IDF words, and a file looks up every word of that
index that it has; each place of such a word meets the template postings of that word,
and the pair votes for a relative position (place in the file less place in the
template).  A template fits at a relative position that
enough different words agree on, and its label counts only where one of its mandatory
phrases stands in the file word by word.  Apart from that, the base phrases are
counted wherever their words stand consecutively.

Only built-in functions are used.  The vocabulary and the postings are fixed by the
templates, so what comes to the driver and what is broadcast doesn't grow with the
corpus.  Votes are grouped by file, template and relative position, so a file that
repeats a word a million times is still spread over tasks.

Defined results: a null or empty text has no words, empty labels, null first and last
word, and score 0; rows that agree in ``doc_id`` and text are one file and get the
same result; a long text is taken whole (its words are one array in a task, about eight
times its bytes); templates that fit a file all count, however many they are; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Words are runs of these after A-Z is lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Template(NamedTuple):
    """``text`` is a notice or a whole licence; ``mandatory`` are phrases in plain words, one of which must stand in a file."""

    label: str
    text: str
    mandatory: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return re.findall(WORD, self.text.lower())


#: A phrase and its label.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Whole licences and notices as they are published.
MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."""
#: Licence notices as they are published, with phrases without which they don't count.
TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", ("permission is hereby granted free of charge",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache org licenses license 2 0",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify",)),
    Template("mit", MIT_TEXT, ("permission is hereby granted free of charge", "mit license")),
    Template("isc", ISC_TEXT, ("permission to use copy modify",)),
    Template("bsd", BSD_TEXT, ("redistribution and use in source and binary forms",)),
    Template("apache-2.0", APACHE_NOTICE, ("apache license version 2", "apache org licenses license 2 0")),
    Template("gpl", GPL_NOTICE, ("gnu general public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)
#: Words that say nothing about licences; they are indexed only inside phrases.
FUNCTION_WORDS = frozenset("a all an and any are as at be but by can do either following for form forms from have if in into is it its may met more must nc no nor not of on or other sa see shall should so that the this to under use used whether whom will with without you your v 0 1 2 3 4".split())


def _words(text: Column) -> Column:
    """Words with A-Z lower-cased.  Two letters whose lower case is ASCII are kept from becoming it."""
    kept = F.replace(F.replace(text, F.lit("K"), F.lit("é")), F.lit("İ"), F.lit("é"))
    return F.regexp_extract_all(F.lower(kept), F.lit(f"({WORD})"), 1)


def _phrases(templates: tuple[Template, ...], base: dict[str, str]) -> list[list[str]]:
    return [p.split() for p in dict.fromkeys([*base, *(m for t in templates for m in t.mandatory)])]


def licence_words(documents: DataFrame, templates: tuple[Template, ...] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """A row a file: ``doc_id, _text`` (its hash), ``n_words``, ``hits`` (places of licence words), ``phrases`` (phrase number and place, in order of place)."""
    phrases = _phrases(templates, base)
    vocabulary = sorted({w for t in templates for w in t.words} - FUNCTION_WORDS)
    heads = sorted({p[0] for p in phrases})
    rows = documents.select("doc_id", F.xxhash64("text").alias("_text"), F.coalesce(_words(F.col("text")), F.array().cast("array<string>")).alias("_w"))
    wanted = sorted({*vocabulary, *heads})
    places = F.when(F.arrays_overlap("_w", F.array(*map(F.lit, wanted))), F.filter(F.transform("_w", lambda w, i: F.struct(i.alias("at"), w.alias("w"))), lambda h: h["w"].isin(*wanted)))
    rows = rows.select("doc_id", "_text", "_w", F.size("_w").cast("long").alias("n_words"), F.coalesce(places, F.array().cast("array<struct<at:int,w:string>>")).alias("_p"))

    def stands(phrase: list[str]) -> Column:
        def here(h: Column) -> Column:
            fits = h["w"] == phrase[0]
            for k, word in enumerate(phrase[1:], 1):
                fits = fits & (F.get(F.col("_w"), h["at"] + k) == word)
            return fits

        return F.transform(F.filter("_p", here), lambda h: h["at"])

    def tagged(k: int, phrase: list[str]) -> Column:
        return F.transform(stands(phrase), lambda at: F.struct(F.lit(k).alias("phrase"), at.alias("at")))

    found = F.flatten(F.array(*[tagged(k, p) for k, p in enumerate(phrases)]))
    return rows.select("doc_id", "_text", "n_words", F.filter("_p", lambda h: h["w"].isin(*vocabulary)).alias("hits"), F.when(F.size("_p") > 0, found).otherwise(F.array().cast("array<struct<phrase:int,at:int>>")).alias("phrases"))


def scan_licenses(documents: DataFrame, templates: tuple[Template, ...] = TEMPLATES, base: dict[str, str] = BASE, index_words: int = 6, least_share: float = 0.6) -> DataFrame:
    """A row a file.

    A template is indexed by its ``index_words`` rarest words among those that any file
    has; it fits where at least ``least_share`` of those agree on one relative position.
    """
    spark, phrases = documents.sparkSession, _phrases(templates, base)
    files = written(licence_words(documents, templates, base), "licence-words")
    total = files.count()
    seen = files.select(F.explode(F.array_distinct("hits.w")).alias("w")).groupBy("w").count().collect()  # at most the vocabulary
    frequency = {r["w"]: r["count"] for r in seen}
    idf = {w: math.log((1 + total) / (1 + frequency.get(w, 0))) for t in templates for w in t.words if w not in FUNCTION_WORDS}
    rarest = lambda words, n: sorted(set(words), key=lambda w: (-idf[w], w))[:n]
    postings, sizes = [], []
    for k, template in enumerate(templates):
        words = template.words
        own = rarest([w for w in words if frequency.get(w)], index_words)
        sizes.append((k, len(own)))
        postings += [(w, k, at) for at, w in enumerate(words) if w in own]
    index = spark.createDataFrame(postings or [("", 0, 0)], "w string, template int, place int")
    needed = spark.createDataFrame([(k, n, [phrases.index(m.split()) for m in t.mandatory], t.label) for (k, n), t in zip(sizes, templates)], "template int, words int, mandatory array<int>, label string")

    looked = files.select("doc_id", "_text", F.explode("hits").alias("h")).select("doc_id", "_text", "h.w", "h.at").distinct()
    votes = looked.join(F.broadcast(index), "w").groupBy("doc_id", "_text", "template", (F.col("at") - F.col("place")).alias("offset")).agg(F.count_distinct("w").alias("agree"))
    best = votes.groupBy("doc_id", "_text", "template").agg(F.max("agree").alias("agree")).join(F.broadcast(needed), "template").withColumn("share", F.col("agree") / F.col("words")).where(F.col("share") >= least_share)
    fits = best.groupBy(F.col("doc_id").alias("_d"), F.col("_text").alias("_t")).agg(F.collect_list(F.struct("label", "share", "mandatory")).alias("_fits"))  # a row a template at most

    joined = files.join(fits, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("_text").eqNullSafe(F.col("_t")), "left")
    in_base = F.filter("phrases", lambda p: p["phrase"] < len(base))
    verified = F.filter(F.coalesce("_fits", F.array().cast("array<struct<label:string,share:double,mandatory:array<int>>>")), lambda f: F.arrays_overlap(f["mandatory"], F.col("_present")))
    labels = F.array(*map(F.lit, base.values()))
    rows = joined.withColumn("_base", in_base).withColumn("_present", F.array_distinct("phrases.phrase"))
    rows = rows.withColumn("_verified", verified).withColumn("_labels", F.array_distinct(F.transform("_base", lambda p: F.get(labels, p["phrase"]))))
    return rows.select(
        "doc_id", "n_words", F.size("_base").cast("long").alias("n_base"),
        F.array_min("_base.at").cast("long").alias("first_word"), F.array_max("_base.at").cast("long").alias("last_word"),
        F.array_join(F.sort_array("_labels"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("_labels", "_verified.label")), ",").alias("labels"),
        F.greatest(F.when(F.size("_base") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max("_verified.share"), F.lit(0.0))).alias("score"),
    )


def _sql_text(*values: str) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _scan_sql(templates: tuple[Template, ...] = TEMPLATES, base: dict[str, str] = BASE, index_words: int = 6, least_share: float = 0.6) -> str:
    phrases = [" ".join(p) for p in _phrases(templates, base)]
    template_rows = ", ".join(f"({k}, {_sql_text(t.label, ' '.join(t.words))})" for k, t in enumerate(templates))
    phrase_rows = ", ".join(f"({_sql_text(p, base.get(p, ''))})" for p in phrases)
    mandatory_rows = ", ".join(f"({k}, {_sql_text(m)})" for k, t in enumerate(templates) for m in t.mandatory)
    return rf"""
WITH files AS (
  SELECT row_number() OVER () AS f, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
places AS (SELECT f, unnest(w) AS word, unnest(range(len(w))) AS pos FROM files),
templates(t, label, body) AS (VALUES {template_rows}),
phrases(phrase, label) AS (VALUES {phrase_rows}),
mandatory(t, phrase) AS (VALUES {mandatory_rows}),
template_words AS (SELECT t, unnest(string_split(body, ' ')) AS word, unnest(range(len(string_split(body, ' ')))) AS place FROM templates),
licence_words AS (SELECT DISTINCT t, word FROM template_words WHERE word NOT IN ({_sql_text(*sorted(FUNCTION_WORDS))})),
hits AS (SELECT DISTINCT f, word, pos FROM places WHERE word IN (SELECT word FROM licence_words)),
frequency AS (SELECT word, count(DISTINCT f) AS n FROM hits GROUP BY word),
rare AS (SELECT t, word FROM licence_words JOIN frequency USING (word) QUALIFY row_number() OVER (PARTITION BY t ORDER BY n, word) <= {index_words}),
sizes AS (SELECT t, count(*) AS words FROM rare GROUP BY t),
votes AS (SELECT f, t, pos - place AS off, count(DISTINCT word) AS agree FROM hits JOIN (SELECT t, word, place FROM template_words JOIN rare USING (t, word)) USING (word) GROUP BY f, t, pos - place),
fits AS (SELECT f, t, max(agree) / any_value(words) AS share FROM votes JOIN sizes USING (t) GROUP BY f, t HAVING max(agree) / any_value(words) >= {least_share}),
stands AS (
  SELECT p.f, phrase, pos FROM places p JOIN phrases ON word = split_part(phrase, ' ', 1) JOIN files USING (f)
  WHERE list_slice(w, pos + 1, pos + len(string_split(phrase, ' '))) = string_split(phrase, ' ')),
verified AS (SELECT DISTINCT f, label, share FROM fits JOIN templates USING (t) JOIN mandatory USING (t) JOIN stands USING (f, phrase)),
in_base AS (SELECT f, count(*) AS n, min(pos) AS lo, max(pos) AS hi, list_sort(list(DISTINCT label)) AS labels FROM stands JOIN phrases USING (phrase) WHERE label <> '' GROUP BY f),
more AS (SELECT f, list(DISTINCT label) AS labels, max(share) AS share FROM verified GROUP BY f)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word, coalesce(array_to_string(b.labels, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') AS labels, greatest(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END, coalesce(share, 0))::DOUBLE AS score
FROM files LEFT JOIN in_base b USING (f) LEFT JOIN more m USING (f)
"""


SCAN_SQL = _scan_sql()
