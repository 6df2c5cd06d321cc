"""Licence scans by sentence rules, in DataFrame operations only.

Text is normalised and cut into sentences; each sentence is looked up among known licence
sentences; the identifiers found, in text order, are matched against ordered licence rules.
Everything happens inside the row: nothing is shuffled, and a hot source costs nothing extra.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences, normalised (lower case, single spaces, no punctuation).
SENTENCES = {
    "licensed under the apache license version 2 0": "apache2-short",
    "licensed under the apache license version 2 0 the license": "apache2-notice",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "you may obtain a copy of the license at": "apache2-copy",
    "released under the mit license": "mit-short",
    "licensed under the mit license": "mit-short",
    "this project is licensed under the mit license": "mit-short",
    "mit license": "mit-title",
    "the mit license mit": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this is free and unencumbered software released into the public domain": "unlicense-short",
    "this work is licensed under the gnu general public license version 3": "gpl3-short",
    "licensed under the gnu general public license version 3": "gpl3-short",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-short",
    "licensed under cc by nc 4 0": "ccbync4-short",
    "licensed under cc by 4 0": "ccby4-short",
    "licensed under cc by sa 4 0": "ccbysa4-short",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby4-long",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "ccbync4-long",
    "all rights reserved": "reserved",
    "licensed under the gnu lesser general public license version 3": "lgpl3-short",
    "licensed under the gnu affero general public license version 3": "agpl3-short",
    "licensed under the bsd 3 clause license": "bsd3-short",
    "licensed under the bsd 2 clause license": "bsd2-short",
    "licensed under the isc license": "isc-short",
    "licensed under the mozilla public license version 2 0": "mpl2-short",
    "licensed under a creative commons attribution 4 0 international license": "ccby4-long",
    "licensed under a creative commons attribution noncommercial 4 0 international license": "ccbync4-long",
    "licensed under a creative commons attribution sharealike 4 0 international license": "ccbysa4-long",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-grant",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0-waiver",
    "terms and conditions for use reproduction and distribution": "apache2-terms",
    "grant of copyright license": "apache2-copyright",
    "grant of patent license": "apache2-patent",
    "spdx license identifier": "spdx",
    "apache 2 0": "id-apache2",
    "mit": "id-mit",
    "bsd 2 clause": "id-bsd2",
    "bsd 3 clause": "id-bsd3",
    "isc": "id-isc",
    "gpl 2 0 only": "id-gpl2",
    "gpl 2 0 or later": "id-gpl2",
    "gpl 3 0 only": "id-gpl3",
    "gpl 3 0 or later": "id-gpl3",
    "lgpl 3 0 only": "id-lgpl3",
    "lgpl 3 0 or later": "id-lgpl3",
    "agpl 3 0 only": "id-agpl3",
    "agpl 3 0 or later": "id-agpl3",
    "mpl 2 0": "id-mpl2",
    "cc0 1 0": "id-cc0",
    "cc by 4 0": "id-ccby4",
    "unlicense": "id-unlicense",
}

# A licence holds where one of its rules' identifiers occur in this order, others between them or not.
RULES = [
    ("Apache-2.0", ["apache2-short"]),
    ("Apache-2.0", ["apache2-notice", "apache2-comply"]),
    ("MIT", ["mit-short"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-title", "mit-grant"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("ISC", ["isc-grant"]),
    ("Unlicense", ["unlicense-short"]),
    ("GPL-3.0", ["gpl3-short"]),
    ("GPL-3.0", ["gpl3-grant", "gpl-warranty"]),
    ("GPL-2.0", ["gpl2-grant", "gpl-warranty"]),
    ("MPL-2.0", ["mpl2-short"]),
    ("CC-BY-NC-4.0", ["ccbync4-short"]),
    ("CC-BY-NC-4.0", ["ccbync4-long"]),
    ("CC-BY-4.0", ["ccby4-short"]),
    ("CC-BY-4.0", ["ccby4-long"]),
    ("CC-BY-SA-4.0", ["ccbysa4-short"]),
    ("all-rights-reserved", ["reserved"]),
    ("Apache-2.0", ["apache2-terms", "apache2-copyright", "apache2-patent"]),
    ("BSD-2-Clause", ["bsd2-short"]),
    ("BSD-3-Clause", ["bsd3-short"]),
    ("ISC", ["isc-short"]),
    ("LGPL-3.0", ["lgpl3-short"]),
    ("LGPL-3.0", ["lgpl3-grant", "gpl-warranty"]),
    ("AGPL-3.0", ["agpl3-short"]),
    ("AGPL-3.0", ["agpl3-grant", "gpl-warranty"]),
    ("MPL-2.0", ["mpl2-short"]),
    ("CC-BY-SA-4.0", ["ccbysa4-long"]),
    ("CC0-1.0", ["cc0-waiver"]),
    ("Apache-2.0", ["spdx", "id-apache2"]),
    ("MIT", ["spdx", "id-mit"]),
    ("BSD-2-Clause", ["spdx", "id-bsd2"]),
    ("BSD-3-Clause", ["spdx", "id-bsd3"]),
    ("ISC", ["spdx", "id-isc"]),
    ("GPL-2.0", ["spdx", "id-gpl2"]),
    ("GPL-3.0", ["spdx", "id-gpl3"]),
    ("LGPL-3.0", ["spdx", "id-lgpl3"]),
    ("AGPL-3.0", ["spdx", "id-agpl3"]),
    ("MPL-2.0", ["spdx", "id-mpl2"]),
    ("CC0-1.0", ["spdx", "id-cc0"]),
    ("CC-BY-4.0", ["spdx", "id-ccby4"]),
    ("Unlicense", ["spdx", "id-unlicense"]),
]

SENTENCE_END = r"[.!?;:]+(?:\s+|\z)"
LINE_END = r"\s*\n\s*"
NOISE = r"[^\p{L}\p{N}\n]+"
#: What stands before a grant inside a longer sentence.
SUBJECT = r"^.* (licensed|released) under "


def _sentences(text: Column, end: str) -> Column:
    cut = F.regexp_replace(F.regexp_replace(text, end, "\n"), NOISE, " ")
    return F.transform(
        F.split(cut, "\n"), lambda s: F.when(F.contains(s, F.lit("ed under ")), F.regexp_replace(F.trim(s), SUBJECT, "$1 under ")).otherwise(F.trim(s))
    )


def _known(sentences: Column) -> Column:
    ids = F.create_map(*[F.lit(x) for x in chain.from_iterable(SENTENCES.items())])
    return F.filter(F.transform(sentences, lambda s: F.element_at(ids, s)), lambda x: x.isNotNull())


def _order(ids: list[str]) -> str:
    return " " + " (.* )?".join(ids) + " "


def licences(text: str | Column) -> Column:
    """Struct of the identifiers found (space-joined, in order) and the licences (sorted, comma-joined).

    Sentences end at . ! ? ; : before white space, and also at line ends; a second reading lets
    sentences run over line ends, for licences wrapped into lines, and is used where a rule needs it.
    A sentence that goes on about who or what is licensed or released counts from that word on.
    Null and empty texts have neither identifiers nor licences: two empty strings.
    """
    lowered = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    by_line = F.array_join(_known(_sentences(lowered, SENTENCE_END)), " ")
    run_on = F.array_join(_known(_sentences(F.regexp_replace(lowered, LINE_END, " "), SENTENCE_END)), " ")
    return F.struct(by_line.alias("by_line"), run_on.alias("run_on"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, sentence_ids, licences, n_licences.

    ``sentence_ids`` is the longer of the two readings' identifiers, the line-wise one on a tie.
    Very long texts are read whole, repeated rows get equal answers, an empty table gives no rows,
    and other columns of docs, of any name, are not read.
    """
    found = docs.select("doc_id", licences("text").alias("_f"))
    line, run = F.concat(F.lit(" "), "_f.by_line", F.lit(" ")), F.concat(F.lit(" "), "_f.run_on", F.lit(" "))
    names = F.array_sort(
        F.array_distinct(
            F.filter(
                F.array(
                    *[F.when(line.rlike(_order(ids)) | run.rlike(_order(ids)), F.lit(name)) for name, ids in RULES]
                ),
                lambda x: x.isNotNull(),
            )
        )
    )
    longer = F.when(F.length("_f.run_on") > F.length("_f.by_line"), F.col("_f.run_on")).otherwise(F.col("_f.by_line"))
    return found.select(
        "doc_id",
        longer.alias("sentence_ids"),
        F.array_join(names, ",").alias("licences"),
        F.size(names).cast("long").alias("n_licences"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


def _sql_reading(text: str) -> str:
    cut = rf"regexp_replace(regexp_replace({text}, '{SENTENCE_END}', chr(10), 'g'), '{NOISE}', ' ', 'g')"
    known = f"list_transform(string_split({cut}, chr(10)), lambda s: map_extract_value(ids, regexp_replace(trim(s), '{SUBJECT}', '\\1 under ')))"
    return f"array_to_string(list_filter({known}, lambda x: x IS NOT NULL), ' ')"


ORACLE = rf"""
WITH k AS (SELECT MAP({_sql_list(SENTENCES)}, {_sql_list(SENTENCES.values())}) AS ids),
t AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents),
f AS (
  SELECT doc_id, {_sql_reading("low")} AS by_line,
         {_sql_reading(f"regexp_replace(low, '{LINE_END}', ' ', 'g')")} AS run_on
  FROM t, k),
r AS (SELECT *, ' ' || by_line || ' ' AS line, ' ' || run_on || ' ' AS run FROM f),
n AS (
  SELECT doc_id, by_line, run_on,
         list_sort(list_distinct(list_filter([{", ".join(f"CASE WHEN regexp_matches(line, '{_order(i)}') OR regexp_matches(run, '{_order(i)}') THEN '{n}' END" for n, i in RULES)}], lambda x: x IS NOT NULL))) AS names
  FROM r)
SELECT doc_id,
       CASE WHEN length(run_on) > length(by_line) THEN run_on ELSE by_line END AS sentence_ids,
       array_to_string(names, ',') AS licences,
       CAST(len(names) AS BIGINT) AS n_licences
FROM n
"""
