"""License scans by recognised sentences.

A text is cut into pieces, each is normalised, and runs of whole pieces that make up a known licence sentence are mapped
to its identifier; the sequence of identifiers is matched against rules that ask for certain identifiers in a certain
order. A stop, a line wrapped before a capital or a comment prefix inside a sentence is a cut like any other, so a notice
is found plain, wrapped or commented. Text between the sentences of a rule doesn't matter. DataFrame functions only; the
tables below are small and fixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text

# Sentences of public licences and their usual notices, as normalised below.
SENTENCES = {
    "mit-notice": "released under the mit license",
    "mit-notice-2": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is-mit": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "as-is-isc": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-grant": "licensed under the apache license version 2 0 the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl-2-notice": "this work is licensed under the gnu general public license version 2",
    "gpl-3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-2-grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-3-grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-as-is": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-notice": "licensed under cc by 4 0",
    "cc-by-sa-notice": "licensed under cc by sa 4 0",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
}
# Licence, and the sentences that must follow one another in this order.
RULES = (
    ("MIT", ("mit-notice",)), ("MIT", ("mit-notice-2",)), ("MIT", ("mit-grant", "mit-keep", "as-is-mit")), ("ISC", ("isc-grant", "as-is-isc")),
    ("Apache-2.0", ("apache-notice",)), ("Apache-2.0", ("apache-grant", "apache-use", "apache-as-is")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")), ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("GPL-2.0", ("gpl-2-notice",)), ("GPL-3.0", ("gpl-3-notice",)), ("GPL-2.0-or-later", ("gpl-2-grant", "gpl-as-is")),
    ("GPL-3.0-or-later", ("gpl-3-grant", "gpl-as-is")), ("MPL-2.0", ("mpl-notice",)), ("CC-BY-4.0", ("cc-by-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",)), ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
)
#: A sentence ends after a stop and white space, at an empty line, or before a line that begins a new one.
_ENDS = ((r"([.!?:;])\s+", "$1\x01"), (r"\n\s*\n", "\x01"), (r"\n([ \t]*(\d+\.|[*-]) |[A-Z][a-z])", "\x01$1"))
#: Comments end a sentence too: the last line of a block of line comments, an opening or closing mark, a comment line that holds
#: nothing else, and the line before one that begins a new sentence.
_LINE = r"(?://+!?|#+|--+|%+)"
_MARK = rf"(?:{_LINE}|/\*+|\*+/?)"
_LAST = ((rf"(?<=\n|^)([ \t]*{_LINE}[ \t][^\n]*)\n(?![ \t]*{_LINE})", "$1\x01\n"),)
_COMMENTS = ((r"<!--|/\*|\*/|-->", "\x01$0"), (rf"(?<=[\n\x01])[ \t]*{_MARK}[ \t\r]*(?=[\n\x01])", "\x01"),
             (rf"(?<=[\n\x01])[ \t]*{_MARK}[ \t]+(?=(?:\d+\.|[*-]) |[A-Z][a-z])", "\x01"))
#: Every known sentence holds one of these words, so other texts have none.
_HINT = "(?i)licen[sc]e|permi|redistribution|warrant|endorse"


def _sentences(text: Column) -> Column:
    for pattern, mark in _LAST + _ENDS + _COMMENTS:
        text = F.regexp_replace(text, pattern, mark)
    return F.split(text, "\x01")


def _normal(sentence: Column) -> Column:
    """ASCII letters in lower case and digits; any run of other characters is one space; list marks go."""
    plain = F.regexp_replace(F.translate(sentence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"^\s*(\d+\.|[*-])\s", "")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def _pattern(sentences: dict[str, str]) -> str:
    """Any known sentence from the start of a piece to the end of one; a sentence of fewer words goes before one that it begins."""
    return "(?<=\x01)(?:" + "|".join(s.replace(" ", "[ \x01]") for s in sorted(sentences.values(), key=len)) + ")(?=\x01)"


def recognise(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules=RULES) -> DataFrame:
    """One row per row of ``docs``: doc_id, sentences array<string>, licences array<string>.

    ``sentences`` are the identifiers in order of the text, repeats included; ``licences`` are the distinct names whose
    rules are met, sorted; a rule that a longer met rule of another licence extends is left out. Both are empty for null
    and empty texts. Null and repeated ids are rows like any other.
    """
    known = F.create_map(*(F.lit(x) for name, text in sentences.items() for x in (text, name)))
    pieces = F.filter(F.transform(_sentences(F.col("_text")), _normal), lambda s: s != "")
    joined = F.concat(F.lit("\x01"), F.array_join(pieces, "\x01"), F.lit("\x01"))
    found = F.transform(F.regexp_extract_all(joined, F.lit(_pattern(sentences)), F.lit(0)), lambda s: F.translate(s, "\x01", " "))
    out = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("_text"))
           .withColumn("_known", F.when(F.col("_text").rlike(_HINT), found))
           .withColumn("sentences", F.coalesce(F.transform("_known", lambda s: known[s]), F.array().cast("array<string>"))))

    def met(rule: tuple[str, ...]) -> Column:
        order = F.array(*map(F.lit, rule))
        return F.aggregate("sentences", F.lit(0), lambda k, s: F.when(F.get(order, k) == s, k + 1).otherwise(k)) == len(rule)

    longer = lambda name, rule: [r for n, r in rules if n != name and len(r) > len(rule) and r[:len(rule)] == rule]
    names = [F.when(met(rule) & ~F.greatest(F.lit(False), F.lit(False), *(met(r) for r in longer(name, rule))), F.lit(name)) for name, rule in rules]
    licences = F.array_sort(F.array_distinct(F.array_compact(F.array(*names))))
    return out.select("doc_id", "sentences", F.when(F.size("sentences") > 0, licences).otherwise(F.array().cast("array<string>")).alias("licences"))
