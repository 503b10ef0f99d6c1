"""Licence scans by sentence rules, in built-in functions only.

A text is cut into sentences, sentences are normalised (ASCII lower case, only letters, digits and dots between them, one
space between words) and looked up among known licence sentences. The identifiers found, in order, are matched against
rules, each an ordered list of identifiers: a rule holds where its identifiers follow each other with only unknown
sentences between. Longer rules are taken first and use up what they match, so a full text isn't reported as its parts. A
sentence that no rule used up, or one that speaks of a licence and isn't known, is counted.

Everything happens inside the row: no shuffle, and no other row's size matters.

Cases: a null or empty text has no sentences and the state `none`; repeated rows are scanned again; a sentence wrapped over lines is
found, as is one on a line of its own among lines without full stops; other columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Wording of public licences, and rules over it.
SENTENCES = {
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "apache-grant": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-asis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "mit-short": "Released under the MIT License.",
    "mit-title": "MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-asis": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "bsd-may": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "rights": "All rights reserved.",
}
RULES = [
    ("Apache-2.0", ["apache-grant", "apache-copy", "apache-asis", "apache-see"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-see"]),
    ("MIT", ["mit-title", "mit-grant", "mit-notice", "mit-asis"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-asis"]),
    ("BSD-3-Clause", ["bsd-may", "bsd-source", "bsd-binary", "bsd-name"]),
    ("BSD-2-Clause", ["bsd-may", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache-short"]),
    ("Apache-2.0", ["apache-grant"]),
    ("GPL-3.0-only", ["gpl3-short"]),
    ("MIT", ["mit-short"]),
    ("MIT", ["mit-title"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("Proprietary", ["rights"]),
]
# End of fixed values.

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_END = r"([.!?:;])[ \t]+|[ \t]*\n[ \t]*\n[ \t\n\x0B\f\r]*|([.!?:;])[ \t]*\n"
_BLANK = " \t\n\x0b\x0c\r"
_NOISE = r"[^a-z0-9.]+"
_HINT = r"licen[cs]e|copyright|rights reserved"


def plain(sentence: str) -> str:
    """The normal form, as `_plain` makes it."""
    import re

    s = re.sub(_NOISE, " ", "".join(c.lower() if c in _UPPER else c for c in sentence))
    return re.sub(r"^ | $", "", re.sub(r" +", " ", re.sub(r"\.( |$)", " ", s)))


def _plain(c: Column) -> Column:
    s = F.regexp_replace(c, _NOISE, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"\.( |$)", " "), " +", " "))


def _coded(sentences: dict[str, str]) -> dict[str, int]:
    return {k: i + 1 for i, k in enumerate(sentences)}


def scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """doc_id, n_sentences, sentence_ids (in order), licenses (sorted, distinct), n_matches (rules that held), n_unused
    (known sentences that no rule used), n_unknown (sentences that speak of a licence and aren't known), state
    (none, known, unknown, both)."""
    sentences, rules = sentences or SENTENCES, rules or RULES
    codes = _coded(sentences)
    text = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    # 1. segments end at sentence ends and blank lines; one that holds line ends is a wrapped sentence, or else lines of which one may be known
    marked = F.regexp_replace(text, _END, "$1$2\u0001")
    parts = F.transform(F.split(marked, "\u0001"), lambda p: F.btrim(p, F.lit(_BLANK)))
    known = F.create_map(*[F.lit(x) for k, s in sentences.items() for x in (plain(s), codes[k])])
    is_known = lambda s: F.try_element_at(known, s).isNotNull()
    lines = lambda p: F.transform(F.split(p, "\n"), _plain)
    tried = F.flatten(F.transform(parts, lambda p: F.when(
        F.contains(p, F.lit("\n")) & F.exists(lines(p), is_known) & ~is_known(_plain(p)), lines(p)).otherwise(F.array(_plain(p)))))
    rows = docs.select("doc_id", F.filter(tried, lambda s: s != "").alias("s"))
    ids = F.filter(F.transform("s", lambda s: F.try_element_at(known, s)), lambda i: i.isNotNull())
    unknown = F.size(F.filter("s", lambda s: s.rlike(_HINT) & F.try_element_at(known, s).isNull()))
    rows = rows.select("doc_id", F.size("s").cast("long").alias("n_sentences"), ids.alias("ids"), unknown.cast("long").alias("n_unknown"))
    # 2. ",1,,2,,5," : a rule is a substring, and what it matched gives way to a bar, which no later rule can span
    rows = rows.withColumn("left", F.array_join(F.transform("ids", lambda i: F.concat(F.lit(","), i.cast("string"), F.lit(","))), ""))
    ordered = sorted(range(len(rules)), key=lambda r: (-len(rules[r][1]), r))
    for r in ordered:
        chain = "".join(f",{codes[k]}," for k in rules[r][1])
        rest = F.replace(F.col("left"), F.lit(chain), F.lit("|"))
        held = (F.length("left") - F.length(rest)) / F.lit(len(chain) - 1)
        rows = rows.select("*", held.cast("long").alias(f"rule{r}"), rest.alias("rest")).drop("left").withColumnRenamed("rest", "left")
    names = F.array(*[F.when(F.col(f"rule{r}") > 0, F.lit(rules[r][0])) for r in range(len(rules))])
    held = sum((F.col(f"rule{r}") for r in range(len(rules))), F.lit(0))
    unused = (F.length("left") - F.length(F.replace(F.col("left"), F.lit(","), F.lit("")))) / 2
    out = rows.select(
        "doc_id", "n_sentences", F.array_join(F.col("ids").cast("array<string>"), ",").alias("sentence_ids"),
        F.array_join(F.array_sort(F.array_distinct(F.filter(names, lambda n: n.isNotNull()))), ",").alias("licenses"),
        held.alias("n_matches"), unused.cast("long").alias("n_unused"), "n_unknown")
    bad = (F.col("n_unused") + F.col("n_unknown")) > 0
    return out.withColumn("state", F.when((F.col("n_matches") > 0) & bad, "both").when(F.col("n_matches") > 0, "known").when(bad, "unknown").otherwise("none"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql() -> str:
    """The same scan in DuckDB."""
    codes = _coded(SENTENCES)
    known = "MAP {" + ", ".join(f"{_quoted(plain(s))}: {codes[k]}" for k, s in SENTENCES.items()) + "}"
    ordered = sorted(range(len(RULES)), key=lambda r: (-len(RULES[r][1]), r))
    steps, last = [], "ided"
    for r in ordered:
        chain = "".join(f",{codes[k]}," for k in RULES[r][1])
        steps.append(f"step{r} AS (SELECT * EXCLUDE (kept), replace(kept, '{chain}', '|') AS kept, "
                     f"((length(kept) - length(replace(kept, '{chain}', '|'))) // {len(chain) - 1})::BIGINT AS rule{r} FROM {last})")
        last = f"step{r}"
    held = " + ".join(f"rule{r}" for r in range(len(RULES)))
    names = ", ".join(f"CASE WHEN rule{r} > 0 THEN {_quoted(RULES[r][0])} END" for r in range(len(RULES)))
    normal = lambda x: rf"trim(regexp_replace(regexp_replace(regexp_replace({x}, '[^a-z0-9.]+', ' ', 'g'), '\.( |$)', ' ', 'g'), ' +', ' ', 'g'))"
    return rf"""
WITH marked AS (
  SELECT doc_id, list_transform(string_split(regexp_replace(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
    '([.!?:;])[ \t]+|[ \t]*\n[ \t]*\n[ \t\n\x0B\f\r]*|([.!?:;])[ \t]*\n', '\1\2' || chr(1), 'g'), chr(1)), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS parts FROM documents),
lined AS (
  SELECT doc_id, list_transform(parts, lambda p: {{'whole': {normal("p")}, 'lines': list_transform(string_split(p, chr(10)), lambda x: {normal("x")})}}) AS t FROM marked),
normal AS (
  SELECT doc_id, list_filter(flatten(list_transform(t, lambda p: CASE WHEN len(p.lines) > 1 AND ({known})[p.whole] IS NULL
    AND len(list_filter(p.lines, lambda x: ({known})[x] IS NOT NULL)) > 0 THEN p.lines ELSE [p.whole] END)), lambda p: p <> '') AS s FROM lined),
ided AS (
  SELECT doc_id, len(s)::BIGINT AS n_sentences, list_filter(list_transform(s, lambda p: ({known})[p]), lambda i: i IS NOT NULL) AS ids,
    len(list_filter(s, lambda p: regexp_matches(p, '{_HINT}') AND ({known})[p] IS NULL))::BIGINT AS n_unknown,
    array_to_string(list_transform(ids, lambda i: ',' || i || ','), '') AS kept FROM normal),
{", ".join(steps)},
summed AS (
  SELECT doc_id, n_sentences, array_to_string(ids, ',') AS sentence_ids,
    array_to_string(list_sort(list_distinct(list_filter([{names}], lambda n: n IS NOT NULL))), ',') AS licenses,
    {held} AS n_matches, ((length(kept) - length(replace(kept, ',', ''))) // 2)::BIGINT AS n_unused, n_unknown FROM {last})
SELECT *, CASE WHEN n_matches > 0 AND n_unused + n_unknown > 0 THEN 'both' WHEN n_matches > 0 THEN 'known'
  WHEN n_unused + n_unknown > 0 THEN 'unknown' ELSE 'none' END AS state FROM summed
"""
