"""Licence scans: matching statistics against a generalised suffix automaton of licence templates."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.llm.scale import bound_batches

#: Phrases whose places are counted, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notices, openings and whole texts of public licences, by label.
TEMPLATES = {
    "mit": [
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
        "permit persons to whom the software is furnished to do so subject to the following conditions",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
        "permit persons to whom the software is furnished to do so subject to the following conditions the above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "software the software is provided as is without warranty of any kind express or implied including but not "
        "limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event "
        "shall the authors or copyright holders be liable for any claim damages or other liability whether in an action "
        "of contract tort or otherwise arising from out of or in connection with the software or the use or other "
        "dealings in the software",
    ],
    "apache": [
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
        "with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless "
        "required by applicable law or agreed to in writing software distributed under the license is distributed "
        "on an as is basis without warranties or conditions of any kind either express or implied see the license "
        "for the specific language governing permissions and limitations under the license",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation",
        "under the terms of the gnu general public license",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation either version 3 of the license or at your "
        "option any later version this program is distributed in the hope that it will be useful but without any "
        "warranty without even the implied warranty of merchantability or fitness for a particular purpose see the "
        "gnu general public license for more details you should have received a copy of the gnu general public "
        "license along with this program",
    ],
    "lgpl": [
        "this work is licensed under the gnu lesser general public license version 3",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser "
        "general public license as published by the free software foundation",
        "under the terms of the gnu lesser general public license",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser "
        "general public license as published by the free software foundation either version 2 1 of the license or at "
        "your option any later version this library is distributed in the hope that it will be useful but without any "
        "warranty without even the implied warranty of merchantability or fitness for a particular purpose see the "
        "gnu lesser general public license for more details you should have received a copy of the gnu lesser general "
        "public license along with this library",
    ],
    "agpl": [
        "this work is licensed under the gnu affero general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero "
        "general public license as published by the free software foundation",
        "under the terms of the gnu affero general public license",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero "
        "general public license as published by the free software foundation either version 3 of the license or at "
        "your option any later version this program is distributed in the hope that it will be useful but without any "
        "warranty without even the implied warranty of merchantability or fitness for a particular purpose see the "
        "gnu affero general public license for more details you should have received a copy of the gnu affero general "
        "public license along with this program",
    ],
    "cc-by": [
        "licensed under cc by 4 0",
        "this work is licensed under a creative commons attribution 4 0 international license to view a copy of this "
        "license visit http creativecommons org licenses by 4 0",
    ],
    "cc-by-sa": [
        "licensed under cc by sa 4 0",
        "this work is licensed under a creative commons attribution sharealike 4 0 international license to view a copy "
        "of this license visit http creativecommons org licenses by sa 4 0",
    ],
    "cc-by-nc": [
        "licensed under cc by nc 4 0",
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license to view a "
        "copy of this license visit http creativecommons org licenses by nc 4 0",
    ],
    "cc0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met redistributions of source code must retain the above copyright notice this "
        "list of conditions and the following disclaimer redistributions in binary form must reproduce the above "
        "copyright notice this list of conditions and the following disclaimer in the documentation and or other "
        "materials provided with the distribution",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met redistributions of source code must retain the above copyright notice this "
        "list of conditions and the following disclaimer redistributions in binary form must reproduce the above "
        "copyright notice this list of conditions and the following disclaimer in the documentation and or other "
        "materials provided with the distribution this software is provided by the copyright holders and contributors "
        "as is and any express or implied warranties including but not limited to the implied warranties of "
        "merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or "
        "contributors be liable for any direct indirect incidental special exemplary or consequential damages including "
        "but not limited to procurement of substitute goods or services loss of use data or profits or business "
        "interruption however caused and on any theory of liability whether in contract strict liability or tort "
        "including negligence or otherwise arising in any way out of the use of this software even if advised of the "
        "possibility of such damage",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies the software "
        "is provided as is and the author disclaims all warranties with regard to this software including all implied "
        "warranties of merchantability and fitness in no event shall the author be liable for any special direct "
        "indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether "
        "in an action of contract negligence or other tortious action arising out of or in connection with the use or "
        "performance of this software",
    ],
    "zlib": [
        "this software is provided as is without any express or implied warranty in no event will the authors be held "
        "liable for any damages arising from the use of this software permission is granted to anyone to use this "
        "software for any purpose including commercial applications and to alter it and redistribute it freely subject "
        "to the following restrictions",
    ],
    "bsl": [
        "distributed under the boost software license version 1 0",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license the software to use reproduce display distribute execute and "
        "transmit the software and to prepare derivative works of the software and to permit third parties to whom the "
        "software is furnished to do so all subject to the following",
    ],
    "epl": [
        "this program and the accompanying materials are made available under the terms of the eclipse public license",
        "licensed under the eclipse public license",
        "under the terms of the eclipse public license",
    ],
    "mpl": [
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was "
        "not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    ],
    "unlicense": [
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish "
        "use compile sell or distribute this software either in source code form or as a compiled binary for any "
        "purpose commercial or non commercial and by any means",
    ],
    "all-rights-reserved": ["all rights reserved"],
}

#: How the licence identifiers of source files begin, by label.
IDENTIFIERS = {
    "mit": "mit", "apache": "apache 2 0", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "cc-by": "cc by 4 0", "cc-by-sa": "cc by sa",
    "cc-by-nc": "cc by nc", "cc0": "cc0 1 0", "bsd": "bsd", "isc": "isc", "zlib": "zlib", "bsl": "bsl 1 0", "epl": "epl", "mpl": "mpl 2 0",
    "unlicense": "unlicense",
}


def all_templates() -> dict[str, list[str]]:
    """``TEMPLATES`` with an identifier line for each of ``IDENTIFIERS``."""
    return {k: [*v, *([f"spdx license identifier {IDENTIFIERS[k]}"] if k in IDENTIFIERS else [])] for k, v in TEMPLATES.items()}


#: A match of so many words is long; shorter templates must match whole.
LONG = 4
#: A chain names its template if it covers this share of it.
COVERED = 0.6
#: So many covered words halve what a span's score lacks: three words say less than a paragraph.
HALF_WORDS = 4

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def word_bytes(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased; none for null."""
    return WORD.findall((text or "").encode().lower())


class SuffixAutomaton:
    """All substrings of several token sequences; every state knows one place, by template, where it ends.

    A state's matches are as long as its ``length`` at most. ``places`` keeps each template's last end
    position for the state's strings: enough to place a match, as long matches recur little in templates.
    """

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[dict[int, int]] = [{}]
        for k, sequence in enumerate(sequences):
            last = 0
            for at, token in enumerate(sequence):
                last = self._extend(last, token)
                self.places[last][k] = at
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            up = self.places[self.link[state]]
            for k, at in self.places[state].items():
                up[k] = max(at, up.get(k, -1))

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        self.places.append({})
        return len(self.length) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, token: int) -> int:
        q = self.next[last].get(token)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, token, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, token, q)
        return new

    def statistics(self, tokens: list[int]) -> Iterator[tuple[int, int, int]]:
        """For each token the state and length of the longest match that ends there, if any."""
        state = length = 0
        for at, token in enumerate(tokens):
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.next[state]:
                state, length = self.next[state][token], length + 1
                yield at, state, length
            else:
                state = length = 0

    def shorter(self, state: int) -> list[tuple[int, int, int]]:
        """Templates that hold a proper suffix of a state's strings only: template, length of the longest, its place."""
        seen, out, up = set(self.places[state]), [], self.link[state]
        while up > 0:
            for k, at in self.places[up].items():
                if k not in seen:
                    seen.add(k)
                    out.append((k, self.length[up], at))
            up = self.link[up]
        return out


class LicenceScanner:
    """Templates, phrases and their words, ready to scan texts."""

    def __init__(self, templates: Mapping[str, list[str]], phrases: Mapping[str, str], long: int, covered: float):
        self.long, self.covered = long, covered
        self.labels = [label for label, texts in templates.items() for _ in texts]
        texts = [text.encode().split() for some in templates.values() for text in some]
        self.ids: dict[bytes, int] = {}
        numbered = [[self.ids.setdefault(w, len(self.ids) + 1) for w in words] for words in texts]
        self.phrases = [
            (np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in phrase.encode().split()]), label)
            for phrase, label in phrases.items()
        ]
        self.sizes = [len(x) for x in numbered]
        self.automaton = SuffixAutomaton(numbered)
        self.least = [min(long, n) for n in self.sizes]
        # Per state: the templates of its whole match, and those of its suffixes, that are long enough to count.
        self.whole = [[(k, at) for k, at in found.items()] for found in self.automaton.places]
        self.suffixes = [[x for x in self.automaton.shorter(s) if x[1] >= self.least[x[0]]] for s in range(len(self.automaton.length))]

    def places(self, ids: np.ndarray) -> list[tuple[int, str]]:
        """Start and label of each place of a phrase."""
        out = []
        for phrase, label in self.phrases:
            n = len(phrase)
            here = np.flatnonzero(ids[: len(ids) - n + 1] == phrase[0]) if len(ids) >= n else np.empty(0, int)
            out += [(int(i), label) for i in here if (ids[i : i + n] == phrase).all()]
        return out

    def spans(self, ids: np.ndarray) -> list[tuple[int, int, int, float, float]]:
        """Covered template spans: first word, word after the last, template, covered share, score.

        For each template the longest match that ends at a word counts where the next word does not lengthen it.
        Those long enough (or as long as the template) and in template order are chained, with gaps up to the
        template's size. Words of a gap beyond those that the template has there count as if the template were so
        much longer.
        """
        chains: dict[int, list[list[int]]] = {}
        known = np.flatnonzero(np.diff(np.concatenate([[0], ids > 0, [0]]).astype(np.int8)))
        least = min(self.least, default=self.long)
        for a, b in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if b - a < least:
                continue
            last: dict[int, tuple[int, int]] = {}
            before = a
            for at, state, length in self.automaton.statistics(ids[a:b].tolist()):
                now: dict[int, tuple[int, int]] = {}
                if length >= least:
                    now = {k: (length, end) for k, end in self.whole[state] if length >= self.least[k]}
                    for k, n, end in self.suffixes[state]:
                        now[k] = (n, end)
                for k, (n, end) in last.items():
                    if a + at != before + 1 or now.get(k, (0, 0))[0] != n + 1:
                        self._chain(chains.setdefault(k, []), k, before - n + 1, n, end - n + 1)
                last, before = now, a + at
            for k, (n, end) in last.items():
                self._chain(chains.setdefault(k, []), k, before - n + 1, n, end - n + 1)
        out = []
        for k, found in chains.items():
            for start, stop, _, words, extra in found:
                share = words / (self.sizes[k] + extra)
                if share >= self.covered:
                    out.append((start, stop, k, share, share * (1 - 0.5 ** (words / HALF_WORDS))))
        return out

    def _chain(self, found: list[list[int]], k: int, start: int, length: int, there: int) -> None:
        """Add a match to the last chain of the template if it follows it in both texts and gains, else start one."""
        if found:
            chain = found[-1]
            _, stop, known, words, extra = chain
            if there + length > known and start + length > stop and start - stop <= self.sizes[k]:
                new = min(there + length - max(there, known), start + length - max(start, stop))
                foreign = extra + max(0, max(0, start - stop) - max(0, there - known))
                if (words + new) * (self.sizes[k] + extra) >= words * (self.sizes[k] + foreign):
                    chain[1:] = [start + length, there + length, words + new, foreign]
                    return
        found.append([start, start + length, there + length, length, 0])

    def disjoint(self, spans: list[tuple[int, int, int, float, float]]) -> list[tuple[int, int, int, float, float]]:
        """Of spans over the same words the one with the best score, in page order; larger templates win ties."""
        kept: list[tuple[int, int, int, float, float]] = []
        for span in sorted(spans, key=lambda s: (-s[4], -self.sizes[s[2]], s[0], s[2])):
            at = bisect.bisect(kept, (span[0],))
            if (at == 0 or kept[at - 1][1] <= span[0]) and (at == len(kept) or kept[at][0] >= span[1]):
                kept.insert(at, span)
        return kept

    def scan(self, text: str | None) -> dict:
        words = word_bytes(text)
        ids = np.fromiter((self.ids.get(w, 0) for w in words), np.int32, len(words))
        places, kept = self.places(ids), self.disjoint(self.spans(ids))
        return {
            "n_words": len(words),
            "n_base": len(places),
            "first_word": min((p for p, _ in places), default=None),
            "last_word": max((p for p, _ in places), default=None),
            "base_labels": ",".join(sorted({label for _, label in places})),
            "labels": ",".join(sorted({label for _, label in places} | {self.labels[k] for _, _, k, _, _ in kept})),
            "score": max((x for *_, x in kept), default=0.0),
            "spans": [{"first": a, "after": b, "label": self.labels[k], "covered": s} for a, b, k, s, _ in kept],
        }


SPAN = T.StructType(
    [
        T.StructField("first", T.LongType()),
        T.StructField("after", T.LongType()),
        T.StructField("label", T.StringType()),
        T.StructField("covered", T.DoubleType()),
    ]
)
FOUND = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()),
    T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(SPAN)),
]


def scan_licences(
    df: DataFrame,
    text_col: str = "text",
    key_cols: tuple[str, ...] = ("doc_id",),
    templates: Mapping[str, list[str]] | None = None,
    phrases: Mapping[str, str] = PHRASES,
    long: int = LONG,
    covered: float = COVERED,
) -> DataFrame:
    """``key_cols`` of each row, phrase places, labels, score and the covered template spans of its whole text.

    ``n_base`` counts all places of the phrases; ``first_word`` and ``last_word`` are their least and greatest
    start, null without any. ``spans`` are disjoint word ranges that cover ``covered`` of a template
    (``all_templates()`` by default) or more by matches of ``long`` words or more; ``score`` is the best share of a
    template, lessened for short ones (see ``HALF_WORDS``), 0 without a span. Only runs of words that occur in
    templates reach the automaton: time is linear in the text, but for sorting the spans found.

    Null and empty texts have no words and empty labels; texts of any length are scanned whole; rows that repeat
    come out as often; an empty table gives an empty table; keys may be null; other columns are not read. No row
    leaves its task.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    bound_batches(df.sparkSession)
    keys = [f"k{i}" for i in range(len(key_cols))]
    slim = df.select(F.col(text_col).alias("text"), *[F.col(c).alias(k) for k, c in zip(keys, key_cols, strict=True)])
    found = T.StructType(FOUND)
    arrow = to_arrow_schema(found)
    settings = (dict(all_templates() if templates is None else templates), dict(phrases), long, covered)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenceScanner(*settings)
        for batch in batches:
            rows = pa.RecordBatch.from_pylist([scanner.scan(text.as_py()) for text in batch.column(0)], schema=arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *rows.columns], names=[*keys, *arrow.names])

    out = slim.mapInArrow(run, T.StructType([*[slim.schema[k] for k in keys], *found.fields]))
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, key_cols, strict=True)], *found.names)


def licence_report(docs: DataFrame) -> DataFrame:
    return scan_licences(docs).drop("spans")
