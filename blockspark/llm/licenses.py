"""License recognition by sentence rules, in DataFrame functions.

A text is cut into sentences, a sentence is normalised (lower case, letters and digits alone, single spaces) and looked up among the
known license sentences.  The identifiers of those found, in order, are then matched against ordered rules: a rule is a sequence of
identifiers that must stand next to each other in it.  A longer rule is met before a shorter one and consumes its identifiers.

A line feed may end a sentence (a notice on its own line) or wrap it: a known sentence is found over consecutive lines too, the longest
one first, though not over a line without letters or digits.  ``oracle_sql`` ends sentences at every line feed, so it has no wrapped ones.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: known sentences of public licenses and notices, by identifier
SENTENCES = {
    "apache2_notice": "Licensed under the Apache License, Version 2.0.",
    "apache2_notice_long": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache2_compliance": "you may not use this file except in compliance with the License.",
    "apache2_copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0.",
    "apache2_disclaimer": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache2_see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit_notice": "Released under the MIT License.",
    "mit_licensed": "Licensed under the MIT License.",
    "mit_grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit_condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "as_is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd_grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd_names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "gpl3_notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl_free": "This program is free software:",
    "gpl3_terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2_terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "mpl2_notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc_by_nc_notice": "Licensed under CC BY-NC 4.0.",
    "cc_by_notice": "Licensed under CC BY 4.0.",
    "cc_by_sa_notice": "Licensed under CC BY-SA 4.0.",
    "cc_by_nc_long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc_by_long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
# fixed values: ordered rules, license and the sentences in their order
RULES = (
    ("Apache-2.0", ("apache2_notice_long", "apache2_compliance", "apache2_copy", "apache2_disclaimer", "apache2_see")),
    ("Apache-2.0", ("apache2_notice_long", "apache2_compliance")),
    ("Apache-2.0", ("apache2_notice",)),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("MIT", ("mit_grant", "mit_condition", "as_is")),
    ("MIT", ("mit_grant", "mit_condition")),
    ("MIT", ("mit_notice",)),
    ("MIT", ("mit_licensed",)),
    ("ISC", ("isc_grant", "as_is")),
    ("ISC", ("isc_grant",)),
    ("GPL-3.0-or-later", ("gpl_free", "gpl3_terms")),
    ("GPL-2.0-or-later", ("gpl_free", "gpl2_terms")),
    ("GPL-3.0-only", ("gpl3_notice",)),
    ("MPL-2.0", ("mpl2_notice",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_notice",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_long",)),
    ("CC-BY-4.0", ("cc_by_notice",)),
    ("CC-BY-4.0", ("cc_by_long",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_notice",)),
    ("Unlicense", ("unlicense",)),
)

_END = r"([.;:!?])[ \t\r\f\x0B]+"  # a sentence ends here, at a line feed and at the end of the text


def normal(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip(" ")


def sentences_of(known: str) -> list[str]:
    """The normal forms of a known sentence, cut as texts are: some hold an inner end, such as "v. 2.0"."""
    return [n for s in re.sub(_END, r"\1\n", known).split("\n") if (n := normal(s))]


def compiled() -> tuple[dict[str, int], list[tuple[str, list[int]]]]:
    """({normal sentence: number}, [(license, numbers)]), longer rules first."""
    numbers: dict[str, int] = {}
    by_id = {i: [numbers.setdefault(n, len(numbers) + 1) for n in sentences_of(s)] for i, s in SENTENCES.items()}
    rules = [(name, [k for i in ids for k in by_id[i]]) for name, ids in RULES]
    return numbers, sorted(rules, key=lambda r: -len(r[1]))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, licenses, n_matches) of every row.

    n_sentences: known license sentences in the text; licenses: the distinct licenses whose rule matches, sorted; n_matches: rules
    matched.  Null and empty texts have none; repeated rows get a row each; an empty table gives none; extra columns are ignored.
    """
    numbers, rules = compiled()
    known = F.create_map(*[F.lit(x) for kv in numbers.items() for x in kv])
    # lower case leaves no A-Z, so H marks a sure end of a sentence and S a line feed, which may be one; all else becomes single spaces
    marked = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[.;:!?][ \t\r\f\x0B\n]+", "H")
    marked = F.regexp_replace(F.translate(marked, "\n", "S"), r"[^a-z0-9HS]+", " ")
    marked = F.regexp_replace(F.trim(F.regexp_replace(marked, " ?([HS]) ?", "$1")), "SS+", "H")
    sentence = "|".join(n.replace(" ", "[ S]") for n in sorted(numbers, key=len, reverse=True))
    matches = F.regexp_extract_all(marked, F.lit(f"(?<![^HS])(?:{sentence})(?![^HS])"), F.lit(0))
    found = docs.select("doc_id", F.transform(matches, lambda s: F.translate(s, "S", " ")).alias("forms"))
    ids = F.transform("forms", lambda s: F.element_at(known, s))
    d = found.select("doc_id", F.size("forms").cast("long").alias("n_sentences"), F.array_join(F.transform(ids, lambda k: F.concat(F.lit(","), k.cast("string"), F.lit(","))), "").alias("left"))
    matched: list[Column] = []
    for k, (name, sequence) in enumerate(rules):
        # ",3,,4,": each number has its own commas, so a removed match leaves a gap that no rule bridges
        text = "".join(f",{x}," for x in sequence)
        n = f"n{k}"
        d = d.withColumn(n, ((F.length("left") - F.length(F.replace("left", F.lit(text), F.lit("")))) / len(text)).cast("long"))
        d = d.withColumn("left", F.replace("left", F.lit(text), F.lit("|")))
        matched.append(F.when(F.col(n) > 0, F.lit(name)))
    total = sum((F.col(f"n{k}") for k in range(1, len(rules))), F.col("n0"))
    return d.select("doc_id", "n_sentences", F.array_sort(F.array_distinct(F.array_compact(F.array(*matched)))).alias("licenses"), total.alias("n_matches"))


def oracle_sql() -> str:
    """The same rows in DuckDB's SQL, with licenses joined by commas; rules are met one after another as above."""
    numbers, rules = compiled()
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table = ", ".join(f"({quote(s)}, {k})" for s, k in numbers.items())
    steps = ["""s as (select doc_id, i, trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'), ' ') as f
      from (select doc_id, unnest(p) as x, generate_subscripts(p, 1) as i
            from (select doc_id, string_split(regexp_replace(coalesce(text, ''), '([.;:!?])[ \\t\\r\\f\\v]+', '\\1' || chr(10), 'g'), chr(10)) as p from documents)))"""]
    steps.append(f"k(f, n) as (values {table})")
    steps.append("h as (select doc_id, count(*) as n_sentences, string_agg(',' || n || ',', '' order by i) as l from s join k using (f) group by doc_id)")
    steps.append("r0 as (select d.doc_id, coalesce(n_sentences, 0) as n_sentences, coalesce(l, '') as l, 0 as m, [] :: varchar[] as names from documents d left join h using (doc_id))")
    for k, (name, sequence) in enumerate(rules):
        text = quote("".join(f",{x}," for x in sequence))
        hits = f"((length(l) - length(replace(l, {text}, ''))) // length({text}))"
        steps.append(f"r{k + 1} as (select doc_id, n_sentences, replace(l, {text}, '|') as l, m + {hits} as m, case when {hits} > 0 then list_append(names, {quote(name)}) else names end as names from r{k})")
    return "with " + ",\n".join(steps) + f"\nselect doc_id, cast(n_sentences as bigint) as n_sentences, array_to_string(list_sort(list_distinct(names)), ',') as licenses, cast(m as bigint) as n_matches from r{len(rules)}"
