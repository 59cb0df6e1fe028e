"""License scans by conditional compression.

Every mention of licensing in a text is a candidate. For each template, the block of words around it is placed by the places where the
template itself mentions licensing, and by the starts of the line and the sentence. Where enough of the template's words stand in the
block in order, and no name, number or denial is among the differing words, the block is compressed alone and with the template as a raw zstandard dictionary; the template that saves the largest
share of bytes wins. The scan goes on after the winner's last word, in the same line too.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import texts, trimmed

#: Words that make a place a candidate.
MENTION = re.compile(r"licen[cs]e|copyright|warrant|public\s+domain|redistribut|permission\s+is\s+hereby|spdx|all\s+rights\s+reserved", re.IGNORECASE)
#: Wordings of notices by license; a license may have several.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("ISC", "Released under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This work is licensed under the Mozilla Public License, version 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
)
#: Words that tell one license from another, besides numbers. None of them may be missing from a notice or be one word too many.
NAMES = frozenset("affero lesser library gnu general mozilla apache mit isc bsd cc cc0 by by-sa by-nc by-nd by-nc-sa by-nc-nd attribution attribution-sharealike attribution-noncommercial attribution-noderivatives unlicense unencumbered 2-clause 3-clause".split())
NUMBER = re.compile(r"v?\d+(\.\d+)*")
#: Words that deny a notice, inside it or at most DENIES words before it.
DENIALS = frozenset("not never no nor neither cannot isn't aren't wasn't without unless".split())
DENIES = 3
WORD = re.compile(r"\S+")


@dataclass(frozen=True)
class Options:
    #: Winners that save a smaller share of bytes, in thousandths, aren't confirmed.
    least_saving: int = 250
    #: The share of the template's words that has to stand in the block in order, in hundredths.
    least_words: int = 85


@dataclass(frozen=True)
class Template:
    name: str
    words: list[str]
    counts: Counter
    #: Which of the words mention licensing.
    mentions: list[int]
    compressor: zstandard.ZstdCompressor

    @property
    def room(self) -> int:
        """How many words a notice may have more than the template."""
        return max(2, len(self.words) // 8)


@cache
def templates() -> tuple[Template, ...]:
    def made(name: str, text: str) -> Template:
        starts = [m.start() for m in WORD.finditer(text) if clean(m[0])]
        mentions = sorted({bisect_right(starts, m.start()) - 1 for m in MENTION.finditer(text)})
        data = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return Template(name, plain(text), Counter(plain(text)), mentions, zstandard.ZstdCompressor(level=19, dict_data=data))

    return tuple(made(*t) for t in TEMPLATES)


@cache
def alone() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=19)


def clean(word: str) -> str:
    return word.strip(".,;:()\"'*#/ ").lower()


def plain(text: str) -> list[str]:
    """Lower-case words without the punctuation around them."""
    return [w for w in map(clean, WORD.findall(text)) if w]


def differences(template: list[str], block: list[str]) -> tuple[int, int, list[str]]:
    """How many of the template's words stand in the block in order, how many words of the block that takes, and the differing words: -missing, +added between matches."""
    same, used, out, edits = 0, 0, [], difflib.SequenceMatcher(None, template, block, autojunk=False).get_opcodes()
    for i, (kind, a, b, c, d) in enumerate(edits):
        if kind == "equal":
            same, used = same + b - a, d
        else:
            out += [f"-{w}" for w in template[a:b]]
            if 0 < i < len(edits) - 1:  # what stands before and after isn't part of the notice
                out += [f"+{w}" for w in block[c:d]]
    return same, used, out


def telling(word: str) -> bool:
    """Whether a word decides which license is meant, or whether one is."""
    return word in NAMES or word in DENIALS or NUMBER.fullmatch(word) is not None


def scan(text: str | None, options: Options = Options()) -> list[tuple[int, str, int, list[str]]]:
    """Start, license, saving in thousandths and differing words of each confirmed notice in a text.

    Each mention is tried, but those inside an earlier notice. Of the templates that the words confirm the one of the largest saving counts.
    """
    if not text or not MENTION.search(text):
        return []
    found = [(w, m.start(), m.end()) for m in WORD.finditer(text) if (w := clean(m[0]))]
    words, starts, ends = zip(*found, strict=True)
    out, low, done, seen = [], 0, 0, 0
    edges = {0}  # words that start the line or the sentence, if no mention before has tried them
    mentions = list(MENTION.finditer(text))
    for mention, after in zip(mentions, [*mentions[1:], None], strict=True):
        for cut in ("\n", ". "):
            if (k := text.rfind(cut, seen, mention.start())) >= 0:
                edges.add(bisect_left(starts, k + 1))
        seen = mention.start()
        if mention.start() < done:
            continue
        at, best = bisect_right(starts, mention.start()) - 1, None
        for i, t in enumerate(templates()):
            least, tried = options.least_words * len(t.words), set()
            for first in {at - k for k in t.mentions} | edges:
                a, b = max(low, first - t.room), max(low, first + len(t.words) + t.room)
                if 100 * (t.counts & Counter(words[a:b])).total() < least:  # no order of the words could do
                    continue
                a += next(j for _, j, n in difflib.SequenceMatcher(None, t.words, words[a:b], autojunk=False).get_matching_blocks() if n)
                b = min(len(words), a + len(t.words) + t.room)
                if a in tried:
                    continue
                tried.add(a)
                same, used, differing = differences(t.words, list(words[a:b]))
                if 100 * same < least or (a > at and after and after.start() < ends[a + used - 1]):  # the next mention finds what starts later
                    continue
                if any(telling(w[1:]) for w in differing) or not DENIALS.isdisjoint(words[max(low, a - DENIES) : a]):
                    continue
                data = " ".join(text[starts[a] : ends[b - 1]].lower().split()).encode("utf-8", "surrogatepass")  # wherever lines are broken
                before = len(alone().compress(data))
                saving = 1000 * (before - len(t.compressor.compress(data))) // before
                if saving >= options.least_saving and (best is None or (saving, len(t.words), -i, -a) > best[0]):
                    best = (saving, len(t.words), -i, -a), a, used, differing
        edges = set()
        if best:
            (saving, _, i, _), a, used, differing = best
            out.append((starts[a], templates()[-i].name, saving, differing))
            low, done = a + used, ends[a + used - 1]
    return out


def notices(docs: DataFrame, options: Options = Options(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and notices array<struct<start, license, saving, differing>> of every row; empty for null, empty and other texts. One pass, no shuffle.

    Whole texts are read, however long; repeated rows repeat; of templates that save the same share the one of more words counts, then the
    first listed; other columns aren't read; an empty table gives no rows.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("license", pa.string()), ("saving", pa.int32()), ("differing", pa.list_(pa.string()))]))

    def run(batches):
        for batch in batches:
            found = [[dict(zip(("start", "license", "saving", "differing"), x, strict=True)) for x in scan(t, options)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "notices"])

    return texts(docs, id_col, text_col).mapInArrow(trimmed(run), "doc_id long, notices array<struct<start: long, license: string, saving: int, differing: array<string>>>")


def digests(docs: DataFrame, options: Options = Options(), **columns: str) -> DataFrame:
    """doc_id, n_notices, licenses (distinct, sorted, joined by spaces), n_differing (words) of every row."""
    found = notices(docs, options, **columns)
    return found.select(
        "doc_id",
        F.size("notices").cast("long").alias("n_notices"),
        F.concat_ws(" ", F.array_sort(F.array_distinct("notices.license"))).alias("licenses"),
        F.aggregate("notices", F.lit(0), lambda n, x: n + F.size(x["differing"])).cast("long").alias("n_differing"),
    )
