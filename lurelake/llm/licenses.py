"""Licence recognition: known sentences to identifiers, identifier sequences to licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Sentences of public licences and notices, normalised (lower case, letters and digits
# only, single spaces), with an identifier of one letter each.
SENTENCES = (
    ("a", "released under the mit license"),
    ("a", "licensed under the mit license"),
    ("a", "this software is released under the mit license"),
    ("b", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("c", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("d", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("e", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("f", "licensed under the apache license version 2 0"),
    ("f", "licensed under the apache license version 2 0 the license"),
    ("g", "you may not use this file except in compliance with the license"),
    ("h", "you may obtain a copy of the license at"),
    ("i", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("j", "see the license for the specific language governing permissions and limitations under the license"),
    ("k", "this work is licensed under the gnu general public license version 3"),
    ("k", "licensed under the gnu general public license version 3"),
    ("l", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("m", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("n", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("o", "see the gnu general public license for more details"),
    ("p", "you should have received a copy of the gnu general public license along with this program"),
    ("q", "licensed under cc by nc 4 0"),
    ("q", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("r", "licensed under cc by 4 0"),
    ("r", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("s", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("t", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("u", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("v", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("w", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("x", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("y", "this is free and unencumbered software released into the public domain"),
    ("z", "all rights reserved"),
)

# Rules in order of precedence; each is a sequence of sentence identifiers and its
# licence.  At one place of a document the first rule that fits takes its sentences.
RULES = (
    ("bcde", "MIT"), ("bcd", "MIT"), ("bc", "MIT"),
    ("stuv", "BSD-3-Clause"), ("stu", "BSD-2-Clause"),
    ("fghij", "Apache-2.0"), ("fgh", "Apache-2.0"), ("gh", "Apache-2.0"),
    ("lnop", "GPL-3.0-or-later"), ("lno", "GPL-3.0-or-later"), ("l", "GPL-3.0-or-later"),
    ("mnop", "GPL-2.0-or-later"), ("mno", "GPL-2.0-or-later"), ("m", "GPL-2.0-or-later"),
    ("a", "MIT"), ("f", "Apache-2.0"), ("k", "GPL-3.0-only"), ("q", "CC-BY-NC-4.0"), ("r", "CC-BY-4.0"),
    ("w", "ISC"), ("x", "MPL-2.0"), ("y", "Unlicense"), ("z", "proprietary"),
)

#: A sentence ends at a line end, or at marks with white space behind them.
SENTENCE_END = r"[\x20\x09-\x0D]*\n[\x20\x09-\x0D]*|[.;:!?]+[\x20\x09-\x0D]+"
#: So many unknown sentences may stand between two of one rule.
MAX_GAP = 2


def normalised_sentence(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))


def recognise_licenses(df: DataFrame, text: str = "text", sentences=SENTENCES, rules=RULES,
                       max_gap: int = MAX_GAP) -> DataFrame:
    """Add n_sentences, sentence_ids, license_rules and licenses to every row; one pass, no shuffle.

    sentence_ids: identifiers of the known sentences in text order; '.' stands where more than
    ``max_gap`` unknown sentences lie between.  license_rules: the rules' sequences, found from the left,
    rules in their order, no sentence used twice.  licenses: their licences, each once, sorted.

    Null or empty text: 0 sentences and empty strings.  Whole texts are read.  Columns of these names in
    the input are replaced.
    """
    ids: dict[str, list[str]] = {}
    for i, s in sentences:
        ids.setdefault(i, []).append(s)
    known = F.create_map(*[F.lit(x) for i, s in sentences for x in (s, i)])
    parts = F.split(F.coalesce(F.col(text), F.lit("")), SENTENCE_END)
    norm = F.filter(F.transform(parts, normalised_sentence), lambda s: s != "")
    found = df.withColumn("_norm", norm)
    found = found.withColumn("_ids", F.transform("_norm", lambda s: F.coalesce(known[s], F.lit("-"))))
    seq = F.regexp_replace(F.array_join("_ids", ""), "-" * (max_gap + 1) + "-*", ".")
    seq = F.regexp_replace(F.regexp_replace(seq, "-", ""), r"^\.|\.$", "")
    licence = F.create_map(*[F.lit(x) for r in rules for x in r])
    pattern = "(" + "|".join(r for r, _ in rules) + ")"
    hits = F.regexp_extract_all("sentence_ids", F.lit(pattern), F.lit(1))
    return (found.withColumn("n_sentences", F.size("_norm").cast("long")).withColumn("sentence_ids", seq)
            .withColumn("_hits", hits).withColumn("license_rules", F.array_join("_hits", " "))
            .withColumn("licenses", F.array_join(F.array_sort(F.array_distinct(
                F.transform("_hits", lambda r: licence[r]))), " "))
            .drop("_norm", "_ids", "_hits"))
