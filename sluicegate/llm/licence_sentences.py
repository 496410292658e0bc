"""License scan: known sentences become numbers, and rules are ordered sequences of them.

A text is cut into sentences and each is normalised to lower-case letters and digits with
single blanks. A sentence of a known licence becomes its number, any other 0. A rule is a
sequence of numbers with at most `MAX_GAP` other sentences between two of them; it is matched
against the text's sequence as a regular expression over numbers. Texts are cut in two ways,
at every line end and at blank lines only, as licences are found wrapped and unwrapped; a
rule holds if it matches in either.

Defined results: a NULL or empty text has no sentences and no licences; a licence that is
found often is named once, and very long texts are taken whole; repeated rows give repeated rows and an empty frame none. Only
the named columns are read. It is one projection: nothing is shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_GAP = 2

# Sentences of public licence texts and notices.
SENTENCES = {
    "mit notice": "Released under the MIT License.",
    "mit licensed": "Licensed under the MIT License.",
    "mit grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "apache notice": "Licensed under the Apache License, Version 2.0.",
    "apache header": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache compliance": "you may not use this file except in compliance with the License.",
    "apache basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "gpl3 notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl redistribute 3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl free software": "This program is free software:",
    "gpl terms 3": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "cc by nc 4 notice": "Licensed under CC BY-NC 4.0.",
    "cc by 4 notice": "Licensed under CC BY 4.0.",
    "cc by sa 4 notice": "Licensed under CC BY-SA 4.0.",
    "isc grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "bsd grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "gpl redistribute 2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl terms 2": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    "gpl version 2": "either version 2 of the License, or (at your option) any later version.",
    "lgpl library": "This library is free software;",
    "lgpl terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;",
    "lgpl version 2.1": "either version 2.1 of the License, or (at your option) any later version.",
    "lgpl version 3": "either version 3 of the License, or (at your option) any later version.",
    "lgpl hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "agpl terms": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl subject cut": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "mpl number": "2.0.",
    "mpl copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "bsd source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "unlicense domain": "This is free and unencumbered software released into the public domain.",
    "unlicense anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc0 extent": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "cc0 warranty": "This software is distributed without any warranty.",
    "zlib as is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib liable": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "boost grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
}


@dataclass(frozen=True)
class LicenceRule:
    """Names of sentences that follow each other, at most `gap` others between two."""

    licence: str
    sentences: tuple[str, ...]
    gap: int = MAX_GAP


RULES = (
    LicenceRule("Apache-2.0", ("apache notice",)),
    LicenceRule("Apache-2.0", ("apache header", "apache compliance")),
    LicenceRule("Apache-2.0", ("apache compliance", "apache basis"), 4),
    LicenceRule("AGPL-3.0", ("gpl free software", "agpl terms", "gpl hope")),
    LicenceRule("BSD", ("bsd grant", "bsd warranty"), 8),
    LicenceRule("BSD-2-Clause", ("bsd source", "bsd binary", "bsd warranty"), 0),
    LicenceRule("BSD-3-Clause", ("bsd source", "bsd binary", "bsd endorse", "bsd warranty"), 1),
    LicenceRule("BSL-1.0", ("boost grant",)),
    LicenceRule("CC0-1.0", ("cc0 extent", "cc0 warranty")),
    LicenceRule("CC-BY-4.0", ("cc by 4 notice",)),
    LicenceRule("CC-BY-NC-4.0", ("cc by nc 4 notice",)),
    LicenceRule("CC-BY-SA-4.0", ("cc by sa 4 notice",)),
    LicenceRule("GPL-2.0", ("gpl redistribute 2", "gpl hope")),
    LicenceRule("GPL-2.0", ("gpl free software", "gpl terms 2", "gpl version 2", "gpl hope")),
    LicenceRule("GPL-3.0", ("gpl3 notice",)),
    LicenceRule("GPL-3.0", ("gpl redistribute 3", "gpl hope")),
    LicenceRule("GPL-3.0", ("gpl free software", "gpl terms 3", "gpl hope")),
    LicenceRule("ISC", ("isc grant", "isc warranty")),
    LicenceRule("LGPL-2.1", ("lgpl library", "lgpl terms", "lgpl version 2.1", "lgpl hope")),
    LicenceRule("LGPL-3.0", ("lgpl library", "lgpl terms", "lgpl version 3", "lgpl hope")),
    LicenceRule("MIT", ("mit notice",)),
    LicenceRule("MIT", ("mit licensed",)),
    LicenceRule("MIT", ("mit grant", "mit condition", "mit warranty")),
    LicenceRule("MPL-2.0", ("mpl subject", "mpl copy")),
    LicenceRule("MPL-2.0", ("mpl subject cut", "mpl number", "mpl copy")),
    LicenceRule("Unlicense", ("unlicense domain", "unlicense anyone")),
    LicenceRule("Zlib", ("zlib as is", "zlib liable")),
)

# What ends a sentence, and what is left of one: the same in every engine.
_BLANKS = r"[ \t\n\x0B\f\r]+"
_END = rf"([.!?:;]['\")]*){_BLANKS}"
_CUT = "\x01"
_OTHER = rf"[^a-z0-9\n{_CUT}]+"


def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def known_sentences(sentences: dict[str, str] = SENTENCES) -> dict[str, int]:
    """Normalised sentence -> number, from 1 in the order of definition."""
    numbers = {normalised(text): i for i, text in enumerate(sentences.values(), 1)}
    if len(numbers) < len(sentences):
        raise ValueError("two sentences are the same once normalised")
    return numbers


def rule_pattern(rule: LicenceRule, sentences: dict[str, str] = SENTENCES) -> str:
    """The rule over a sequence written as ` 3  0  17 `, a blank on each side of each."""
    numbers = {name: i for i, name in enumerate(sentences, 1)}
    return f"(?:  ?[0-9]+ ){{0,{rule.gap}}}".join(f" {numbers[name]} " for name in rule.sentences)


def _sequence(sentences: Column, known: dict[str, int]) -> Column:
    """The numbers as text, from an array of normalised sentences."""
    numbers = F.transform(
        F.filter(F.transform(sentences, lambda s: F.trim(s)), lambda s: s != ""),
        lambda s: F.when(
            s.isin(list(known)), F.array_position(F.array(*[F.lit(k) for k in known]), s).cast("string")
        ).otherwise(F.lit("0")),
    )
    return F.array_join(F.transform(numbers, lambda n: F.concat(F.lit(" "), n, F.lit(" "))), "")


def with_sequences(docs: DataFrame, key: str, text: str, sentences: dict[str, str] = SENTENCES) -> DataFrame:
    """key, by_line, by_block: the texts as sequences of sentence numbers."""
    known = known_sentences(sentences)
    marked = F.regexp_replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), _END, f"$1{_CUT}")
    plain = docs.select(
        F.col(f"`{key}`").alias("key"), F.regexp_replace(F.lower(marked), _OTHER, " ").alias("plain")
    )
    blocks = F.regexp_replace(F.regexp_replace("plain", r"\n(?: ?\n)+", _CUT), r" ?\n ?", " ")
    return plain.select(
        "key",
        _sequence(F.split("plain", f"[{_CUT}\n]"), known).alias("by_line"),
        _sequence(F.split(blocks, _CUT), known).alias("by_block"),
    )


def scan_licences(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    sentences: dict[str, str] = SENTENCES,
    rules: tuple[LicenceRule, ...] = RULES,
) -> DataFrame:
    """One row per document: key, licences (sorted, different), n_known (known sentences,
    counted by lines)."""
    names = sorted({r.licence for r in rules})
    sequences = with_sequences(docs, key, text, sentences)

    def holds(name: str) -> Column:
        any_ = "|".join(rule_pattern(r, sentences) for r in rules if r.licence == name)
        return F.col("by_line").rlike(any_) | F.col("by_block").rlike(any_)

    found = F.array_compact(F.array(*[F.when(holds(name), F.lit(name)) for name in names]))
    return sequences.select(
        F.col("key").alias(key), found.alias("licences"), F.regexp_count("by_line", F.lit(" [1-9][0-9]* ")).cast("bigint").alias("n_known")
    )
