"""Licence scans by sentence rules, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and their usual notices, normalised (lower case, other than letters and digits one space), with an identifier each.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache2-notice",
    "licensed under the apache license version 2 0 the license": "apache2-notice",
    "you may not use this file except in compliance with the license": "apache2-compliance",
    "you may obtain a copy of the license at": "apache2-copy",
    "apache license": "apache2-title",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-warranty",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-see",
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "this project is licensed under the mit license": "mit-notice",
    "the mit license mit": "mit-title",
    "mit license": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "licensed under the bsd license": "bsd-notice",
    "this work is licensed under the gnu general public license version 3": "gpl3-notice",
    "licensed under the gnu general public license version 3": "gpl3-notice",
    "gnu general public license": "gpl-title",
    "version 3 29 june 2007": "gpl3-version",
    "version 2 june 1991": "gpl2-version",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "see the gnu general public license for more details": "gpl-see",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-notice",
    "gnu lesser general public license": "lgpl-title",
    "version 2 1 february 1999": "lgpl21-version",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21-grant",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-grant",
    "gnu affero general public license": "agpl-title",
    "version 3 19 november 2007": "agpl3-version",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-grant",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at": "epl2-notice",
    "eclipse public license v 2 0": "epl2-title",
    "boost software license version 1 0": "bsl1-title",
    "distributed under the boost software license version 1 0": "bsl1-notice",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0-grant",
    "licensed under cc by nc 4 0": "ccbync4-notice",
    "licensed under cc by 4 0": "ccby4-notice",
    "licensed under cc by sa 4 0": "ccbysa4-notice",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby4-notice",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "ccbync4-notice",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
}

#: Licences by ordered rules: a rule matches where its identifiers occur in this order, others allowed between.
RULES = {
    "Apache-2.0": [["apache2-notice"], ["apache2-compliance", "apache2-copy"]],
    "MIT": [["mit-notice"], ["mit-grant", "mit-condition"], ["mit-title", "mit-grant"]],
    "BSD-3-Clause": [["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]],
    "BSD-2-Clause": [["bsd-grant", "bsd-source", "bsd-binary"]],
    "GPL-3.0": [["gpl3-notice"], ["gpl3-grant"], ["gpl-title", "gpl3-version"]],
    "GPL-2.0": [["gpl2-grant"], ["gpl-title", "gpl2-version"]],
    "LGPL-2.1": [["lgpl21-grant"], ["lgpl-title", "lgpl21-version"]],
    "LGPL-3.0": [["lgpl3-grant"], ["lgpl-title", "gpl3-version"]],
    "AGPL-3.0": [["agpl3-grant"], ["agpl-title", "agpl3-version"]],
    "EPL-2.0": [["epl2-notice"], ["epl2-title"]],
    "BSL-1.0": [["bsl1-notice"], ["bsl1-title"]],
    "CC0-1.0": [["cc0-grant"]],
    "MPL-2.0": [["mpl2-notice"]],
    "CC-BY-NC-4.0": [["ccbync4-notice"]],
    "CC-BY-4.0": [["ccby4-notice"]],
    "CC-BY-SA-4.0": [["ccbysa4-notice"]],
    "Unlicense": [["unlicense-grant"]],
    "ISC": [["isc-grant"]],
}
#: Where a licence of the left is found, that of the right, part of it, isn't told.
PART_OF = {"BSD-3-Clause": "BSD-2-Clause"}
#: The SQL looks only at raw sentences that hold one of these; 'version 3, 29' and 'version 2, june' as they are written don't.
WORDS = "licen|permission|redistribut|merchantab|copyright notice|version 3 29|version 2 june|free software|public domain|noninfring|endorse"
END = r"([.!?;:]['\")]*)[ \t\r]+"
#: (1), a) and the like where a line begins, comment signs before it allowed: a known sentence may start after it.
MARKER = r"(\n[^\p{L}\p{N}\n(]*\(?[0-9A-Za-z]{1,3}\))[ \t]+"
#: What may stand between two words of a known sentence: line ends and sentence ends too ('v. 2.0', 'free software; you').
GAP = r"[ \n|]"


def sentences(text: Column) -> Column:
    """Sentences end at . ! ? ; : followed by white space, and at line ends."""
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), END, "$1\n"), "\n")


def marked(text: Column) -> Column:
    """A whole text in lower case, words (of letters and digits) one space apart, or where a line ends between them one line end, where else a sentence ends or a list marker stands one |."""
    cut = F.regexp_replace(F.concat(F.lit("\n"), F.translate(F.coalesce(text, F.lit("")), "|", ","), F.lit("\n")), END, "$1|")
    cut = F.regexp_replace(cut, MARKER, "$1|")
    words = F.regexp_replace(F.lower(cut), r"[^a-z0-9\n|]+", " ")
    return F.regexp_replace(F.regexp_replace(words, r"[ |]*\n[ \n|]*", "\n"), r" *\|[ |]*", "|")


def known() -> str:
    """Java's expression for the longest known sentence (group 1) at a place where one may start. It takes no characters, so one inside another is found too."""
    longest = sorted(SENTENCES, key=len, reverse=True)
    return r"(?<![^\n|])(?=(" + "|".join(k.replace(" ", GAP) for k in longest) + r")(?![^\n|]))"


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences in the order of their starts, wherever their lines are wrapped and whatever ends of sentences they hold."""
    names = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    found = F.regexp_extract_all(marked(text), F.lit(known()), F.lit(1))
    return F.transform(found, lambda s: F.element_at(names, F.translate(s, "\n|", "  ")))


def follows(ids: Column, rule: list[str]) -> Column:
    """Whether the identifiers of rule occur in ids in their order: one pass that counts how many have been met."""
    wanted = F.array(*[F.lit(r) for r in rule])
    met = F.aggregate(ids, F.lit(0), lambda k, i: F.when(F.get(wanted, k) == i, k + 1).otherwise(k))
    return met == len(rule)


def scan_licences(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licences): known sentences of each whole text in their order, and the licences whose rules they satisfy, by name; both joined by commas.

    Lines and sentences are joined for known sentences, but each counts for n_sentences. One pass of column functions, without shuffle, join or Python. Null text: no sentences (0) and empty strings.
    Null ids and repeated rows are scanned like others. Empty table: no rows.
    """
    n = F.size(F.filter(sentences(F.col("text")), lambda s: F.trim(s, F.lit(" \t\r")) != "")).cast("long")
    a = docs.select("doc_id", n.alias("n_sentences"), sentence_ids(F.col("text")).alias("ids"))
    told = {name: _any([follows(F.col("ids"), rule) for rule in rules]) for name, rules in RULES.items()}
    for whole, part in PART_OF.items():
        told[part] = told[part] & ~told[whole]
    names = F.filter(F.array(*[F.when(told[n], F.lit(n)) for n in sorted(told)]), lambda n: n.isNotNull())
    return a.select("doc_id", "n_sentences", F.concat_ws(",", "ids").alias("sentence_ids"), F.when(F.size("ids") > 0, F.concat_ws(",", names)).otherwise("").alias("licences"))


def _any(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out | c
    return out


def oracle(table: str = "documents") -> str:
    """DuckDB's SQL for known sentences that don't run over the end of a line or sentence; scan_licences() finds these and those that do."""
    known = ", ".join(f"'{k}': '{v}'" for k, v in SENTENCES.items())
    test = {}
    for name, rules in RULES.items():
        test[name] = "(" + " or ".join("regexp_matches(ids, '(^|,)" + "(,.*)?,".join(rule) + "(,|$)')" for rule in rules) + ")"
    for whole, part in PART_OF.items():
        test[part] = f"({test[part]} and not {test[whole]})"
    names = ", ".join(f"case when {test[n]} then '{n}' end" for n in sorted(test))
    return f"""
with cut as (
  select doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?;:][''")]*)[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10)) as found from {table}
), seen as (
  select doc_id, cast(len(list_filter(found, lambda s: trim(s, ' ' || chr(9) || chr(13)) <> '')) as bigint) as n_sentences,
    list_filter(list_transform(list_filter(found, lambda s: regexp_matches(lower(s), '{WORDS}')),
      lambda s: map {{{known}}}[trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))]), lambda i: i is not null) as list_ids from cut
), joined as (select doc_id, n_sentences, coalesce(array_to_string(list_ids, ','), '') as ids from seen)
select doc_id, n_sentences, ids as sentence_ids,
  case when ids = '' then '' else coalesce(array_to_string(list_filter([{names}], lambda n: n is not null), ','), '') end as licences
from joined
"""
