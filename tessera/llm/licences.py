"""Licence scans with a positional index of rare words.

The index holds where each word stands in the licence templates. How rare a
word is comes from the number of documents that have it, over the whole
corpus. Of each template of which a file has enough words, the file's rarest
ones are looked up, so many that no notice can do without all of them. Each of
their places votes for where the template would start. Where votes fall close
together the other words' places are intersected with the template's by
relative position: words may be put in, left out or changed, as names and years
are, as long as starts differ by SHIFT at most and enough words stand in order.
What stands there is verified by the mandatory key phrase.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_and_text, session, table, with_number

# Phrases whose places are counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Licence notices that are looked for: label -> (mandatory key phrase, text); another wording of the same
# label has something after a slash.
TEMPLATES = {
    "agpl": (
        "gnu affero general public license",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license "
        "as published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    "apache": (
        "apache license",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at",
    ),
    "apache/header": (
        "apache license",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
        "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    "apache/terms": (
        "apache license",
        "apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution 1 definitions "
        "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document",
    ),
    "bsd": (
        "redistribution and use in source and binary forms",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    ),
    "bsd/two clauses": (
        "redistribution and use in source and binary forms",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
        "in the documentation and or other materials provided with the distribution",
    ),
    "boost": (
        "boost software license",
        "boost software license version 1 0 august 17th 2003 permission is hereby granted free of charge to any person or organization obtaining a copy "
        "of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software",
    ),
    "cc": (
        "creative commons",
        "this work is licensed under a creative commons attribution international license",
    ),
    "cc0": (
        "waived all copyright and related or neighboring rights",
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    ),
    "gpl": (
        "general public license",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
        "as published by the free software foundation",
    ),
    "gpl/header": (
        "gnu general public license",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
        "as published by the free software foundation either version 2 of the license or at your option any later version "
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
        "merchantability or fitness for a particular purpose see the gnu general public license for more details "
        "you should have received a copy of the gnu general public license along with this program",
    ),
    "gpl/terms": (
        "gnu general public license",
        "gnu general public license version 3 29 june 2007 copyright c 2007 free software foundation inc everyone is permitted to copy and distribute "
        "verbatim copies of this license document but changing it is not allowed preamble the gnu general public license is a free copyleft license "
        "for software and other kinds of works",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies",
    ),
    "lgpl": (
        "gnu lesser general public license",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license "
        "as published by the free software foundation either version 2 1 of the license or at your option any later version",
    ),
    "mit": (
        "permission is hereby granted free of charge",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction",
    ),
    "mit/terms": (
        "permission is hereby granted free of charge",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute "
        "sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other "
        "liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    "mpl": (
        "mozilla public license",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
    ),
    "unlicense": (
        "free and unencumbered software released into the public domain",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software "
        "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
    "zlib": (
        "this software is provided as is without any express or implied warranty",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
    ),
    "apache/note": ("apache license", "this work is licensed under the apache license version 2 0"),
    "gpl/note": ("general public license", "this work is licensed under the gnu general public license version 3"),
    "mit/note": ("mit license", "this work is licensed under the mit license"),
}
#: Share of a template's words that must stand in order.
COVERAGE = 0.6
#: By how many words a notice may be longer or shorter than its template so far: so many, and a share of its length.
SHIFT, SHIFT_SHARE = 8, 0.2
#: Words that may stand between those of the key phrase.
BETWEEN = 1

_WORD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Words of a text: letters and digits of ASCII and all else above it, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD).split()


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which the phrase's words stand consecutively in `` a b c ``."""
    found, needle, at, word, last = [], b" " + phrase + b" ", -1, 0, 0
    while (at := joined.find(needle, at + 1)) >= 0:
        word += joined.count(b" ", last, at)
        last = at
        found.append(word)
    return found


def in_order(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The most hits (place in the file, place in the template), both growing, by ascending place in the file."""
    ends: list[int] = []  # the smallest last template place of a chain of each length
    last: list[int] = []
    before: list[int] = []
    # Of one place in the file the largest template place comes first, so that only one of them gets into a chain.
    hits = sorted(hits, key=lambda h: (h[0], -h[1]))
    for k, (_, place) in enumerate(hits):
        n = bisect_left(ends, place)
        before.append(last[n - 1] if n else -1)
        if n == len(ends):
            ends.append(place)
            last.append(k)
        else:
            ends[n], last[n] = place, k
    chain, k = [], last[-1] if last else -1
    while k >= 0:
        chain.append(hits[k])
        k = before[k]
    return chain[::-1]


def has_phrase(text: list[bytes], key: list[bytes]) -> bool:
    """Whether the key's words stand in order, with BETWEEN others among them at most."""
    for start, w in enumerate(text):
        if w == key[0]:
            n = 0
            for other in text[start : start + len(key) + BETWEEN]:
                n += n < len(key) and other == key[n]
            if n == len(key):
                return True
    return False


class Index:
    """Postings of all templates and the weight of each of their words."""

    def __init__(self, templates: dict[str, tuple[str, str]] = TEMPLATES):
        self.templates = {label: (key.encode().split(), text.encode().split()) for label, (key, text) in templates.items()}
        self.postings: dict[bytes, dict[str, list[int]]] = {}
        for label, (_, text) in self.templates.items():
            for place, word in enumerate(text):
                self.postings.setdefault(word, {}).setdefault(label, []).append(place)
        self.vocabulary = set(self.postings)
        self.needs = {label: math.ceil(COVERAGE * len(text)) for label, (_, text) in self.templates.items()}
        self.shift = {label: SHIFT + int(SHIFT_SHARE * len(text)) for label, (_, text) in self.templates.items()}
        self.idf = dict.fromkeys(self.vocabulary, 0.0)

    def weigh(self, documents: dict[bytes, int], n: int) -> None:
        """Sets the words' weights from the number of documents that have them, of n in all."""
        self.idf = {w: math.log((n + 1) / (documents.get(w, 0) + 1)) for w in self.vocabulary}

    def search(self, text: list[bytes]) -> dict[str, float]:
        """Labels that are verified, with the largest share of a template's words that stand in order.

        The weights say which words are looked up, never what is found: a
        template's words that aren't looked up are too few for a notice.
        """
        there = self.vocabulary.intersection(text)
        held: Counter = Counter()
        for w in there:
            for label, at in self.postings[w].items():
                held[label] += len(at)
        likely = [label for label, n in held.items() if n >= self.needs[label]]
        if not likely:
            return {}
        places_: dict[bytes, list[int]] = {w: [] for w in there}
        for i, w in enumerate(text):
            if w in there:
                places_[w].append(i)
        out: dict[str, float] = {}
        for label in sorted(likely):
            name = label.split("/")[0]
            share = self.best(label, text, places_, held[label], out.get(name, 0.0))
            if share > out.get(name, 0.0):
                out[name] = share
        return out

    def best(self, label: str, text: list[bytes], places_: dict[bytes, list[int]], held: int, known: float) -> float:
        """The largest share over ``known`` of the template's words in order around a key phrase; ``known`` if there is none."""
        key, template = self.templates[label]
        need, shift = self.needs[label], self.shift[label]
        own = {w: self.postings[w][label] for w in places_ if label in self.postings[w]}
        votes: set[int] = set()
        for w in sorted(own, key=lambda w: (-self.idf[w], w)):
            if held < need:
                break
            held -= len(own[w])
            votes.update(i - place for i in places_[w] for place in own[w])
        for low, high in stretches(sorted(votes), shift):
            hits = []
            for w, at in own.items():
                for place in at:
                    hits += [(i - place, i, place) for i in places_[w][bisect_left(places_[w], low + place) : bisect_right(places_[w], high + place)]]
            for n, band in bands(sorted(hits), shift, need):
                if n / len(template) <= known:
                    break  # the fullest come first
                chain = in_order(band)
                share = len(chain) / len(template)
                if len(chain) >= need and share > known and has_phrase(text[max(chain[0][0] - len(key), 0) : chain[-1][0] + len(key) + 1], key):
                    known = share
        return known


def stretches(votes: list[int], shift: int) -> list[tuple[int, int]]:
    """Ranges of starts within ``shift`` of the votes; those that overlap are one."""
    out: list[tuple[int, int]] = []
    for v in votes:
        if out and v - shift <= out[-1][1]:
            out[-1] = (out[-1][0], v + shift)
        else:
            out.append((v - shift, v + shift))
    return out


def bands(hits: list[tuple[int, int, int]], shift: int, need: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Hits ``(start, i, place)`` whose starts are within ``shift``, with the number of their different places, the most first.

    Bands with fewer than ``need`` places are left out.
    """
    out, stop, held = [], 0, Counter()
    for k, (start, _, place) in enumerate(hits):
        while stop < len(hits) and hits[stop][0] <= start + shift:
            held[hits[stop][2]] += 1
            stop += 1
        if len(held) >= need and (k == 0 or hits[k - 1][0] < start):
            out.append((len(held), k, stop))
        held[place] -= 1
        if not held[place]:
            del held[place]
    out.sort(key=lambda b: (-b[0], b[1]))
    return [(n, [h[1:] for h in hits[k:stop]]) for n, k, stop in out]


def document_frequencies(docs: DataFrame, vocabulary: set[bytes]) -> tuple[dict[bytes, int], int]:
    """How many documents have each word of the (bounded) vocabulary, and how many there are."""
    session(docs)

    def run(batches):
        counts: Counter = Counter()
        for pdf in batches:
            for t in pdf["text"]:
                counts.update(vocabulary.intersection(words(t)))
            counts[b""] += len(pdf)
        if counts:
            yield pd.DataFrame({"word": [w.decode() for w in counts], "n": list(counts.values())}, columns=["word", "n"])

    counted = docs.select(F.col("text").cast("string")).mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"].encode(): r["n"] for r in counted.toLocalIterator()}
    return found, found.pop(b"", 0)


def scan(docs: DataFrame, templates: dict[str, tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Places of phrases and labels of licences for every row of ``docs(doc_id, text)``.

    Columns: n_words, n_base (places of all phrases), first_word and last_word
    (their smallest and largest start; null without any), base_labels, labels
    (the templates' too), score (1 with a base place, else the best verified
    template's share of words in order, else 0). Null and empty texts have no
    words; repeated rows give one row each; a null doc_id stays null; other
    columns are ignored; a very long text is scanned as a whole; an empty table
    gives an empty result. What other documents hold decides which words are
    looked up, never which labels are found.
    """
    index = Index(templates)
    index.weigh(*document_frequencies(docs, index.vocabulary))
    shared = session(docs).sparkContext.broadcast(index)
    sought = [(p.encode(), label) for p, label in phrases.items()]

    def run(batches):
        own = shared.value
        for pdf in batches:
            rows = []
            for t in pdf["text"]:
                text = words(t)
                joined = b" " + b" ".join(text) + b" "
                at = {label: places(joined, p) for p, label in sought}
                every = [i for x in at.values() for i in x]
                base = {label for label, x in at.items() if x}
                verified = own.search(text)
                score = 1.0 if base else max(verified.values(), default=0.0)
                rows.append((len(text), len(every), min(every, default=None), max(every, default=None), ",".join(sorted(base)), ",".join(sorted(base | verified.keys())), score))
            out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
            out[["first_word", "last_word"]] = out[["first_word", "last_word"]].astype("Int64")
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    kind = "doc_id string, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return with_number(id_and_text(docs).mapInPandas(run, kind))


def op5(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
