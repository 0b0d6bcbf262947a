"""License scans by sentence rules: sentences become identifiers, and sequences of identifiers licences.

DataFrame functions only, each row by itself: no shuffle, so no key can be hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import table

#: Known licence sentences: identifier and the normalised sentence (a-z, 0-9 and single spaces), or the part of it that tells
#: it; where several fit at one place, the first counts.
SENTENCES = (
    ("apache2", "licensed under the apache license (version )?2 0"),
    ("apache2_not_use", "you may not use this file except in compliance with the license"),
    ("apache2_copy", "you may obtain a copy of the license at"),
    ("apache2_basis", "software distributed under the license is distributed on an as is basis"),
    ("apache2_see", "see the license for the specific language governing permissions and limitations under the license"),
    ("mit", "(released|licensed|available|distributed) under the (terms of the )?mit license"),
    ("mit_grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files( the software)?"),
    ("mit_notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("as_is", "the software is provided as is without warranty of any kind"),
    ("mit_liable", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("isc_grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc_as_is", "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("bsd_use", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd_source", "redistributions of source code must retain"),
    ("bsd_binary", "redistributions in binary form must reproduce"),
    ("bsd_name", "neither the name of[a-z0-9 ]{0,120}contributors may be used to endorse or promote products"),
    ("bsd_as_is", "this software is provided by the copyright holders and contributors as is"),
    ("zlib_as_is", "this software is provided as is without any express or implied warranty"),
    ("zlib_origin", "the origin of this software must not be misrepresented"),
    ("zlib_altered", "altered source versions must be plainly marked as such"),
    ("boost_grant", "boost software license version 1 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("lgpl", "gnu lesser general public license( as published by the free software foundation)?|lgpl( ?v?[0-9]( [0-9])?)?"),
    ("agpl", "gnu affero general public license( as published by the free software foundation)?|agpl( ?v?[0-9]( [0-9])?)?"),
    ("gpl_warranty", "without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl_received", "you should have received a copy of the gnu general public license along with this program"),
    ("gpl3_later", "(gnu general public license|gpl)( as published by the free software foundation)?( either)?( version| ?v)? ?3( 0)?( of the license)? or at your option any later version"),
    ("gpl2_later", "(gnu general public license|gpl)( as published by the free software foundation)?( either)?( version| ?v)? ?2( 0)?( of the license)? or at your option any later version"),
    ("gpl3", "(gnu general public license|gpl)( as published by the free software foundation)?( version| ?v)? ?3"),
    ("gpl2", "(gnu general public license|gpl)( as published by the free software foundation)?( version| ?v)? ?2"),
    ("mpl2", "mozilla public license (v |version )?2 0"),
    ("mpl2_copy", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("epl2", "eclipse public license (v |version )?2 0"),
    ("cc_by_nc_nd", "cc by nc nd 4 0|attribution noncommercial noderivatives 4 0"),
    ("cc_by_nc_sa", "cc by nc sa 4 0|attribution noncommercial sharealike 4 0"),
    ("cc_by_nc", "cc by nc 4 0|attribution noncommercial 4 0"),
    ("cc_by_sa", "cc by sa 4 0|attribution sharealike 4 0"),
    ("cc_by", "cc by 4 0|attribution 4 0 international"),
    ("cc0", "cc0 1 0"),
    ("all_rights", "all rights reserved"),
)
#: Licences as sequences of identifiers, tried in this order; a match is used up.
RULES = (
    ("BSD-3-Clause", ("bsd_use", "bsd_source", "bsd_binary", "bsd_name", "bsd_as_is")),
    ("BSD-3-Clause", ("bsd_use", "bsd_source", "bsd_binary", "bsd_name")),
    ("BSD-2-Clause", ("bsd_use", "bsd_source", "bsd_binary", "bsd_as_is")),
    ("BSD-2-Clause", ("bsd_use", "bsd_source", "bsd_binary")),
    ("Apache-2.0", ("apache2", "apache2_not_use", "apache2_copy", "apache2_basis", "apache2_see")),
    ("Apache-2.0", ("apache2", "apache2_not_use", "apache2_copy", "apache2_basis")),
    ("Apache-2.0", ("apache2", "apache2_copy", "apache2_basis")),
    ("MIT", ("mit_grant", "mit_notice", "as_is", "mit_liable")),
    ("MIT", ("mit_grant", "mit_notice", "as_is")),
    ("MIT", ("mit_grant", "mit_notice")),
    ("ISC", ("isc_grant", "isc_as_is")),
    ("Zlib", ("zlib_as_is", "zlib_origin", "zlib_altered")),
    ("GPL-3.0-or-later", ("gpl3_later", "gpl_warranty", "gpl_received")),
    ("GPL-2.0-or-later", ("gpl2_later", "gpl_warranty", "gpl_received")),
    ("MPL-2.0", ("mpl2", "mpl2_copy")),
    ("Apache-2.0", ("apache2",)),
    ("MIT", ("mit",)),
    ("BSL-1.0", ("boost_grant",)),
    ("Unlicense", ("unlicense",)),
    ("LGPL", ("lgpl",)),
    ("AGPL", ("agpl",)),
    ("GPL-3.0-or-later", ("gpl3_later",)),
    ("GPL-2.0-or-later", ("gpl2_later",)),
    ("GPL-3.0", ("gpl3",)),
    ("GPL-2.0", ("gpl2",)),
    ("MPL-2.0", ("mpl2",)),
    ("EPL-2.0", ("epl2",)),
    ("CC-BY-NC-ND-4.0", ("cc_by_nc_nd",)),
    ("CC-BY-NC-SA-4.0", ("cc_by_nc_sa",)),
    ("CC-BY-NC-4.0", ("cc_by_nc",)),
    ("CC-BY-SA-4.0", ("cc_by_sa",)),
    ("CC-BY-4.0", ("cc_by",)),
    ("CC0-1.0", ("cc0",)),
    ("Proprietary", ("all_rights",)),
)
#: A text without one of these, in either case, holds no known sentence; it costs one search.
CUE = "(?i)licen[cs]e|redistribut|permission|warranty|gnu |neither the name|gpl|cc0|cc by|cc-by|creative commons|attribution|rights reserved|no event shall|software is provided|this software|public domain|source versions"
#: Where a paragraph ends: a line of white space and comment marks alone. Where a sentence does. A line feed within a
#: paragraph ends neither, so a notice may be wrapped and stand in a comment.
BREAK = r"[.!?]+(?:[\x20\x09-\x0D]+|$)|\n[\x20\x09\x0B-\x0D*#/;-]*\n"
#: A sentence begins and ends with whole words: no GPL in AGPL, no version 2 in 2019.
ANY_SENTENCE = r"\b(?:" + "|".join(f"(?:{p})" for _, p in SENTENCES) + r")\b"


def identifiers(text: Column) -> Column:
    """The known sentences of a text as |a|b|, in its order."""
    sentences = F.filter(F.split(F.lower(text), BREAK), lambda s: s.rlike(CUE))
    plain = F.transform(sentences, lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))
    parts = F.flatten(F.transform(plain, lambda s: F.regexp_extract_all(s, F.lit(f"({ANY_SENTENCE})"), F.lit(0))))

    def known(s: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, pattern in reversed(SENTENCES):
            out = F.when(s.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
        return out

    names = F.transform(parts, known)
    return F.when(F.size(names) > 0, F.concat(F.lit("|"), F.array_join(names, "|"), F.lit("|"))).otherwise("")


def find_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, sentences (known ones as |a|b|, empty if none), licenses (comma-joined in the order of the rules), n_licenses.

    A null or empty text has none. Known sentences that complete no rule stand in `sentences` alone. Repeated rows
    repeat their result; other columns aren't read.
    """
    rows = docs.select(F.col(key), F.col(text).alias("__t"))
    rows = rows.select(key, F.when(F.col("__t").rlike(CUE), identifiers(F.col("__t"))).otherwise("").alias("sentences"))
    # identifiers stand between double bars, so that a sequence that is used up leaves its neighbours' bars alone
    left, found = F.regexp_replace("sentences", r"\|", "||"), []
    for name, sequence in RULES:
        said = "|" + "||".join(sequence) + "|"
        found.append(F.when(F.contains(left, F.lit(said)), F.lit(name)))
        left = F.replace(left, F.lit(said), F.lit("|*|"))
    return rows.select(key, "sentences", F.when(F.col("sentences") == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(F.array(*found)))).alias("__l")).select(
        key, "sentences", F.array_join("__l", ",").alias("licenses"), F.size("__l").cast("long").alias("n_licenses")
    )


def sql() -> str:
    """The same rows from DuckDB."""
    case = " ".join(f"WHEN regexp_full_match(s, '{p}') THEN '{n}'" for n, p in SENTENCES)
    steps, last = ["s0 AS (SELECT doc_id, sentences, replace(sentences, '|', '||') AS l, []::VARCHAR[] AS f FROM named)"], "s0"
    for i, (name, sequence) in enumerate(RULES):
        said = "|" + "||".join(sequence) + "|"
        found = f"CASE WHEN contains(l, '{said}') AND NOT list_contains(f, '{name}') THEN list_append(f, '{name}') ELSE f END"
        steps.append(f"s{i + 1} AS (SELECT doc_id, sentences, replace(l, '{said}', '|*|') AS l, {found} AS f FROM {last})")
        last = f"s{i + 1}"
    return f"""
WITH split AS (SELECT doc_id, regexp_split_to_array(lower(coalesce(text, '')), '{BREAK}') AS x FROM documents),
rows_ AS (SELECT doc_id, unnest(x) AS q, generate_subscripts(x, 1) AS i FROM split),
found AS (SELECT doc_id, i, regexp_extract_all(trim(regexp_replace(q, '[^a-z0-9]+', ' ', 'g')), '{ANY_SENTENCE}') AS y FROM rows_ WHERE regexp_matches(q, '{CUE}')),
parts AS (SELECT doc_id, i, unnest(y) AS s, generate_subscripts(y, 1) AS j FROM found),
known AS (SELECT doc_id, i, j, CASE {case} END AS n FROM parts),
joined AS (SELECT doc_id, '|' || string_agg(n, '|' ORDER BY i, j) || '|' AS sentences FROM known WHERE n IS NOT NULL GROUP BY doc_id),
named AS (SELECT d.doc_id, coalesce(j.sentences, '') AS sentences FROM documents d LEFT JOIN joined j USING (doc_id)),
{", ".join(steps)}
SELECT doc_id, sentences, coalesce(array_to_string(f, ','), '') AS licenses, len(f)::BIGINT AS n_licenses FROM {last}"""


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document."""
    return find_licenses(table(spark, sf_dir, "documents"))
