"""Operator 9: licence scan by a positional rare-token index.

Templates (short notices and the openings of longer texts) are indexed by word with
positions. One pass counts in how many documents each word of the templates occurs, so that
rarity comes from the whole corpus; only these counts (one row for each template word)
reach the driver. Each template is then posted under its rarest words alone.

A document's words are looked up in that index; a hit at file position p of a word at
template position q proposes the alignment p - q. Alignments that most of the template's
rare words agree on (within a slack, for inserted or lost words) are verified: the share of
the template's words found there, and all of its mandatory phrases. The base phrases go
through the same index: each is posted under its rarest word and verified word by word.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_batch, batches, table, text_or_empty

#: Base phrases and their labels (fixed values).
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: label, wording, mandatory phrases (fixed values: public licence notices, lower case, words only).
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted", "without restriction")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license",)),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "version 3")),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license", "version 2")),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("lgpl", "licensed under the gnu lesser general public license version 2 1", ("gnu lesser general public license",)),
    ("agpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu affero general public license", "version 3")),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("neither the name of", "endorse or promote products derived")),
    ("bsd-2", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by", ("must reproduce the above copyright notice", "this software is provided by")),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("epl-1", "all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", ("eclipse public license v1 0",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications", ("in no event will the authors be held liable", "including commercial applications")),
    ("cc0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    ("cc0", "released under cc0 1 0 universal public domain dedication", ("cc0 1 0 universal",)),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software", ("person or organization obtaining a copy",)),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", ("changing it is allowed as long as the name is changed",)),
    ("artistic-2", "this program is free software you can redistribute it and or modify it under the terms of the artistic license 2 0", ("artistic license",)),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license", ("creative commons attribution noderivatives",)),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license", ("creative commons attribution noncommercial sharealike",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
)
#: Rarest words under which a template is posted, and how many of them must agree on an alignment (rounded up).
RARE_WORDS, AGREE = 4, 0.5
#: Words that may be inserted or lost between two rare words, and the share of a template's words needed.
SLACK, MATCHED = 3, 0.8

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else (b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32) for b in range(256))


def file_words(text: str) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return [w for w in text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split(b" ") if w]


def _as_words(phrase: str) -> tuple[bytes, ...]:
    return tuple(w.encode() for w in phrase.split())


class Index:
    """Postings of base phrases and templates under their rarest words."""

    def __init__(self, n_documents: int, found_in: dict[bytes, int]):
        self.idf = lambda w: math.log((n_documents + 1) / (found_in.get(w, 0) + 1))
        rank = lambda w: (-self.idf(w), w)
        self.phrases: dict[bytes, list] = defaultdict(list)  # rarest word -> (place in phrase, phrase, label)
        for phrase, label in BASE:
            words = _as_words(phrase)
            rare = min(words, key=rank)
            self.phrases[rare].append((words.index(rare), words, label))
        self.postings: dict[bytes, list] = defaultdict(list)  # rare word -> (template, place)
        self.templates = []
        for t, (label, wording, must) in enumerate(TEMPLATES):
            words = _as_words(wording)
            rare = sorted(set(words), key=rank)[:RARE_WORDS]
            for w in rare:
                for q, x in enumerate(words):
                    if x == w:
                        self.postings[w].append((t, q))
            self.templates.append((label, words, [_as_words(m) for m in must], math.ceil(AGREE * len(rare))))
        self.words = frozenset(self.phrases) | frozenset(self.postings)

    def scan(self, text: str) -> tuple[int, list[tuple[int, str]], dict[str, float]]:
        """Words, base places (start, label) and the best match of each label found by templates."""
        words = file_words(text)
        if self.words.isdisjoint(words):
            return len(words), [], {}
        known = self.words
        at = [(i, w) for i, w in enumerate(words) if w in known]
        places = []
        agree: dict[int, dict[int, set]] = defaultdict(lambda: defaultdict(set))
        for i, w in at:
            for q, phrase, label in self.phrases.get(w, ()):
                s = i - q
                if s >= 0 and tuple(words[s : s + len(phrase)]) == phrase:
                    places.append((s, label))
            for t, q in self.postings.get(w, ()):
                agree[t][i - q].add(w)
        best: dict[str, float] = {}
        for t, by_start in agree.items():
            label, template, must, least = self.templates[t]
            done = -1
            for s in sorted(by_start):
                if s <= done:
                    continue
                near = set().union(*(by_start.get(s + k, ()) for k in range(SLACK + 1)))
                if len(near) < least:
                    continue
                window = words[max(0, s) : max(0, s) + len(template) + SLACK]
                score = self._verify(window, template, must)
                if score >= MATCHED:
                    best[label] = max(best.get(label, 0.0), score)
                    done = s + SLACK
        return len(words), sorted(places), best

    @staticmethod
    def _verify(window: list[bytes], template: tuple[bytes, ...], must: list[tuple[bytes, ...]]) -> float:
        """Share of the template's words met in order in the window, each within the slack; 0 without a mandatory phrase."""
        joined = b" " + b" ".join(window) + b" "
        if any(b" " + b" ".join(m) + b" " not in joined for m in must):
            return 0.0
        at = met = 0
        for w in template:
            ahead = window[at : at + SLACK + 1]
            if w in ahead:
                at += ahead.index(w) + 1
                met += 1
        return met / len(template)


_DF_SCHEMA = pa.schema([("word", pa.string()), ("n", pa.int64())])


def build_index(docs: DataFrame, text_column: str = "text") -> Index:
    """Document counts of the templates' words over all of ``docs``."""
    vocabulary = {w for p, _ in BASE for w in _as_words(p)} | {w for _, p, _ in TEMPLATES for w in _as_words(p)}

    def count(it):
        found: dict[bytes, int] = defaultdict(int)
        n = 0
        for b in batches(it, 256):
            for t in b.column(0).to_pylist():
                n += 1
                for w in vocabulary.intersection(file_words(t)):
                    found[w] += 1
        yield as_batch({"word": ["", *(w.decode() for w in found)], "n": [n, *found.values()]}, _DF_SCHEMA)

    # One row for each word of the templates (about 150), and one for the number of documents.
    rows = docs.select(text_or_empty(docs, text_column).alias("t")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n")).collect()
    counts = {w.encode(): n for w, n in rows}
    return Index(counts.pop(b"", 0), counts)


_OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_OUT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Words, base places and labels, one row for each row of ``docs``.

    Null text: as empty (0 words, no labels, score 0). Score: 1 with a base place, else the
    best matched share of a template. Repeated rows: each has its row. Empty table: none.
    """
    index = build_index(docs, text_column)
    posted, templates, phrases = dict(index.postings), index.templates, dict(index.phrases)

    def run(it):
        own = Index.__new__(Index)
        own.postings, own.templates, own.phrases, own.words = posted, templates, phrases, frozenset(posted) | frozenset(phrases)
        for b in batches(it, 256):
            rows: list[tuple] = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, places, best = own.scan(t)
                base = sorted({x for _, x in places})
                score = 1.0 if places else max(best.values(), default=0.0)
                rows.append((d, n, len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(base), ",".join(sorted({*base, *best})), score))
            if rows:
                yield as_batch(dict(zip(_OUT_SCHEMA.names, map(list, zip(*rows, strict=True)), strict=True)), _OUT_SCHEMA)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(docs, text_column).alias("t")).mapInArrow(run, _OUT)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
