"""Operator 3: licence scan with a generalised suffix automaton of licence words.

Phrases and template texts are put into one automaton over word ids. Streaming a text through it gives the matching
statistics: at each word the longest run ending there that occurs in any template. Base phrases are read off the states on
the way. Matches of MIN_MATCH words or more that cannot be extended are chained, in order in the text and in the template,
with a few words between them (a fifth of the template's, MAX_GAP at most). A chain is a span with its template's label if it covers
enough of it and holds each of its deciding phrases without a gap, which are the words that tell the licence from others. Where spans of
different labels overlap, the one that covers more words stays.

Only runs of known words are stepped through; a word outside all templates resets the statistics anyway.

Null and empty texts have no words, no labels ("") and score 0. Repeated rows come out as often as they came in; the
columns `keep` pass through, and those named like a result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewise.llm.shared import map_texts
from tidewise.llm.words import chunks, hash_word, words

MIN_MATCH, MAX_GAP, MIN_COVERED = 4, 12, 0.6

#: The phrases whose places are counted exactly.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Words of well-known licences and notices, (label, text, deciding phrases).
TEMPLATES = [
    ("mit", "released under the mit license", ("the mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", ()),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ()),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", ("authors or copyright holders be liable",)),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache license version 2",)),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ()),
    ("apache-2", "apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution", ("apache license version 2 0 january 2004",)),
    ("apache-2", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form", ()),
    ("apache-1.1", "licensed under the apache license version 1 1", ("apache license version 1 1",)),
    ("apache-1.1", "the apache software license version 1 1 copyright c 2000 the apache software foundation all rights reserved", ("apache software license version 1 1",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ()),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ()),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ()),
    ("bsd-2", "licensed under the bsd 2 clause license", ("bsd 2 clause",)),
    ("bsd-3", "licensed under the bsd 3 clause license", ("bsd 3 clause",)),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ()),
    ("bsd-4", "all advertising materials mentioning features or use of this software must display the following acknowledgement", ("advertising materials mentioning features",)),
    ("gpl", "this work is licensed under the gnu general public license", ("gnu general public license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("the gnu general public license",)),
    ("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("the gnu general public license", "version 2 of the license")),
    ("gpl-2", "gnu general public license version 2 june 1991 copyright c 1989 1991 free software foundation inc", ("gnu general public license version 2 june 1991",)),
    ("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("the gnu general public license", "version 3 of the license")),
    ("gpl-3", "gnu general public license version 3 29 june 2007 copyright c 2007 free software foundation inc", ("gnu general public license version 3 29 june 2007",)),
    ("lgpl", "this work is licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("the gnu lesser general public license",)),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation", ("the gnu library general public license",)),
    ("lgpl-2.1", "gnu lesser general public license version 2 1 february 1999 copyright c 1991 1999 free software foundation inc", ("gnu lesser general public license version 2 1",)),
    ("lgpl-3", "gnu lesser general public license version 3 29 june 2007 copyright c 2007 free software foundation inc", ("gnu lesser general public license version 3",)),
    ("agpl", "this work is licensed under the gnu affero general public license", ("gnu affero general public license",)),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ("the gnu affero general public license",)),
    ("agpl-3", "gnu affero general public license version 3 19 november 2007 copyright c 2007 free software foundation inc", ("gnu affero general public license version 3",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("provided that the above copyright notice",)),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ()),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("mpl-2", "licensed under the mozilla public license version 2 0", ("mozilla public license version 2 0",)),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1 the license you may not use this file except in compliance with the license", ("mozilla public license version 1 1",)),
    ("epl-1", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution", ("eclipse public license v1 0",)),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at", ("eclipse public license 2 0",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("authors be held liable",)),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", ()),
    ("boost", "boost software license version 1 0 august 17th 2003", ("boost software license version 1 0",)),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software", ("person or organization obtaining a copy",)),
    ("artistic-2", "the artistic license 2 0 copyright c 2000 2006 the perl foundation", ("artistic license 2 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ()),
    ("cc0", "creative commons legal code cc0 1 0 universal", ("cc0 1 0 universal",)),
    ("cc0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
]
#: Names of the Creative Commons licences.
CREATIVE_COMMONS = {
    "cc-by": "attribution",
    "cc-by-sa": "attribution sharealike",
    "cc-by-nd": "attribution noderivatives",
    "cc-by-nc": "attribution noncommercial",
    "cc-by-nc-sa": "attribution noncommercial sharealike",
    "cc-by-nc-nd": "attribution noncommercial noderivatives",
}
for _label, _name in CREATIVE_COMMONS.items():
    _short = _label.replace("-", " ")
    TEMPLATES.append((_label, f"licensed under {_short}", (_short,)))
    for _version in ("4 0 international", "3 0 unported"):
        TEMPLATES.append((_label, f"this work is licensed under a creative commons {_name} {_version} license", (f"creative commons {_name} {_version[:3]}",)))
        TEMPLATES.append((_label, f"creative commons {_name} {_version[:3]}", (f"creative commons {_name} {_version[:3]}",)))
#: Identifiers of licences in SPDX lines.
IDENTIFIERS = {
    "mit": ["mit"],
    "mit-0": ["mit 0"],
    "apache-1.1": ["apache 1 1"],
    "apache-2": ["apache 2 0"],
    "bsd-2": ["bsd 2 clause"],
    "bsd-3": ["bsd 3 clause"],
    "bsd-4": ["bsd 4 clause"],
    "gpl-2": ["gpl 2 0", "gpl 2 0 only", "gpl 2 0 or later"],
    "gpl-3": ["gpl 3 0", "gpl 3 0 only", "gpl 3 0 or later"],
    "lgpl-2.1": ["lgpl 2 1", "lgpl 2 1 only", "lgpl 2 1 or later"],
    "lgpl-3": ["lgpl 3 0", "lgpl 3 0 only", "lgpl 3 0 or later"],
    "agpl-3": ["agpl 3 0", "agpl 3 0 only", "agpl 3 0 or later"],
    "isc": ["isc"],
    "0bsd": ["0bsd"],
    "mpl-1.1": ["mpl 1 1"],
    "mpl-2": ["mpl 2 0"],
    "epl-1": ["epl 1 0"],
    "epl-2": ["epl 2 0"],
    "zlib": ["zlib"],
    "boost": ["bsl 1 0"],
    "artistic-2": ["artistic 2 0"],
    "unlicense": ["unlicense"],
    "cc0": ["cc0 1 0"],
    "cc-by": ["cc by 3 0", "cc by 4 0"],
    "cc-by-sa": ["cc by sa 3 0", "cc by sa 4 0"],
    "cc-by-nd": ["cc by nd 3 0", "cc by nd 4 0"],
    "cc-by-nc": ["cc by nc 3 0", "cc by nc 4 0"],
    "cc-by-nc-sa": ["cc by nc sa 3 0", "cc by nc sa 4 0"],
    "cc-by-nc-nd": ["cc by nc nd 3 0", "cc by nc nd 4 0"],
}
#: Names by which licences go, of four words or more.
NAMES = {
    "apache-2": ["apache license 2 0", "the apache 2 0 license"],
    "bsd-2": ["bsd 2 clause license", "the simplified bsd license"],
    "bsd-3": ["bsd 3 clause license", "the new bsd license"],
    "bsd-4": ["bsd 4 clause license"],
    "gpl": ["gnu general public license"],
    "gpl-2": ["gnu general public license version 2", "gnu general public license v2", "gnu gpl version 2", "the gnu gpl v2"],
    "gpl-3": ["gnu general public license version 3", "gnu general public license v3", "gnu gpl version 3", "the gnu gpl v3"],
    "lgpl": ["gnu lesser general public license", "gnu library general public license"],
    "lgpl-2.1": ["gnu lesser general public license version 2 1"],
    "lgpl-3": ["gnu lesser general public license version 3"],
    "agpl": ["gnu affero general public license"],
    "agpl-3": ["gnu affero general public license version 3"],
    "isc": ["under the isc license"],
    "mpl-1.1": ["mozilla public license version 1 1", "mozilla public license 1 1"],
    "mpl-2": ["mozilla public license version 2 0", "mozilla public license 2 0"],
    "epl-1": ["eclipse public license version 1 0", "eclipse public license v 1 0", "eclipse public license 1 0", "eclipse public license v1 0"],
    "epl-2": ["eclipse public license version 2 0", "eclipse public license v 2 0", "eclipse public license 2 0", "eclipse public license v2 0"],
    "zlib": ["under the zlib license"],
    "boost": ["boost software license version 1 0", "boost software license 1 0"],
    "artistic-2": ["artistic license 2 0", "artistic license version 2 0"],
    "unlicense": ["released under the unlicense"],
    "cc0": ["cc0 1 0 universal", "creative commons zero v1 0"],
}
# an identifier and a name count as a whole only
TEMPLATES += [(_label, _text, (_text,)) for _label, _ids in IDENTIFIERS.items() for _text in (f"spdx license identifier {_id}" for _id in _ids)]
TEMPLATES += [(_label, _text, (_text,)) for _label, _texts in NAMES.items() for _text in _texts]


class Automaton:
    """Generalised suffix automaton of word-id sequences."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for sequence in sequences:
            last = 0
            for word in sequence:
                last = self._add(last, word)
        #: Places of the strings of each state: (sequence, end), kept for all suffixes as well.
        self.places: list[set[tuple[int, int]]] = [set() for _ in self.next]
        for n, sequence in enumerate(sequences):
            state = 0
            for end, word in enumerate(sequence, 1):
                state = self.next[state][word]
                up = state
                while up > 0:
                    self.places[up].add((n, end))
                    up = self.link[up]

    def _state(self, length: int, link: int, steps: dict[int, int]) -> int:
        self.next.append(steps)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """The state of the strings of q that extend p by word, parted from longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        part = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = part
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = part
            p = self.link[p]
        return part

    def _add(self, last: int, word: int) -> int:
        if word in self.next[last]:  # an earlier sequence went here
            return self._split(last, self.next[last][word], word)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][word], word)
        return new

    def statistics(self, sequence: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest match that ends at each word."""
        state = length = 0
        for word in sequence:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            yield state, length

    def ancestors(self, state: int) -> Iterator[int]:
        while state > 0:
            yield state
            state = self.link[state]


class Scanner:
    def __init__(self, phrases: Mapping[str, str], templates: list[tuple[str, str, tuple[str, ...]]]):
        sequences = [_words(t) for t in (*phrases, *(text for _, text, _ in templates))]
        ids = {w: i for i, w in enumerate(sorted({w for s in sequences for w in s}))}
        coded = [[ids[w] for w in s] for s in sequences]
        self.automaton = Automaton(coded)
        hashes = np.array([hash_word(w.encode()) for w in ids], np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = np.append(hashes[self.order], np.uint64(2**64 - 1))
        self.order = np.append(self.order, -1)
        self.labels = [*phrases.values(), *(label for label, _, _ in templates)]
        self.deciding = [[] for _ in phrases] + [[_place(_words(text), _words(p)) for p in deciding] for _, text, deciding in templates]
        self.sizes = [len(s) for s in sequences]
        self.n_phrases = len(phrases)
        self.shortest = min([MIN_MATCH, *self.sizes[: self.n_phrases]])
        ends: dict[int, list[int]] = {}
        for n in range(len(sequences)):
            # phrases, and templates that their deciding phrase is all of, count where they stand as a whole; matches tell only the longest strings
            if n < self.n_phrases or (0, self.sizes[n]) in self.deciding[n]:
                for state, _ in self.automaton.statistics(coded[n]):
                    pass
                ends.setdefault(state, []).append(n)
        #: Those that are suffixes of the strings of each state, given a match as long as they are.
        self.wholes_at = [[n for s in self.automaton.ancestors(state) for n in ends.get(s, ())] for state in range(len(self.automaton.next))]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Word ids, -1 for words outside all templates."""
        at = np.searchsorted(self.hashes, hashes)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[dict]:
        """A record for each row of a chunk."""
        hashes, rows, _, _ = words(data, offsets)
        ids = self.ids(hashes)
        known = np.append(ids >= 0, False)
        start = known.copy()
        start[1:] &= ~known[:-1]
        edges = np.unique(rows[rows < len(ids)])
        start[edges] = known[edges]
        first = np.flatnonzero(start)
        stop = np.unique(np.concatenate([np.flatnonzero(~known), rows]))
        last = stop[np.searchsorted(stop, first, "right")] if len(first) else first
        long = last - first >= self.shortest
        first, last = first[long], last[long]
        row_of = np.searchsorted(rows, first, "right") - 1
        out = [{"n_words": n, "base": [], "wholes": [], "matches": []} for n in np.diff(rows).tolist()]
        for lo, hi, row in zip(first.tolist(), last.tolist(), row_of.tolist(), strict=True):
            self._run(ids[lo:hi].tolist(), lo - int(rows[row]), out[row])
        return [self._record(r) for r in out]

    def _run(self, run: list[int], at: int, record: dict) -> None:
        """Base phrases and unextendable long matches of one run of known words, from word `at` of its text."""
        before = (0, 0)
        for i, (state, length) in enumerate(self.automaton.statistics(run)):
            for n in self.wholes_at[state]:
                if self.sizes[n] <= length:
                    record["base" if n < self.n_phrases else "wholes"].append((at + i + 1 - self.sizes[n], n))
            if before[1] >= MIN_MATCH and length <= before[1]:
                record["matches"].append((at + i, *before))
            before = state, length
        if before[1] >= MIN_MATCH:
            record["matches"].append((at + len(run), *before))

    def _record(self, r: dict) -> dict:
        wholes = [{"label": self.labels[n], "template": n - self.n_phrases, "first": at, "last": at + self.sizes[n] - 1, "covered": 1.0} for at, n in r["wholes"]]
        chains = [s for s in self._spans(r["matches"]) if (s["template"], s["first"]) not in {(w["template"], w["first"]) for w in wholes}]
        base, spans = sorted(r["base"]), self._apart(chains + wholes, r["n_words"])
        base_labels = sorted({self.labels[n] for _, n in base})
        return {
            "n_words": r["n_words"],
            "n_base": len(base),
            "first_word": base[0][0] if base else None,
            "last_word": base[-1][0] if base else None,
            "base_labels": ",".join(base_labels),
            "labels": ",".join(sorted({*base_labels, *(s["label"] for s in spans)})),
            "score": 1.0 if base else max((s["covered"] for s in spans), default=0.0),
            "spans": spans,
        }

    def _spans(self, matches: list[tuple[int, int, int]]) -> list[dict]:
        """Chains of matches (end in the text, state, length) that cover a template enough and hold its deciding phrases."""
        per: dict[int, list[tuple[int, int, int]]] = {}
        for end, state, length in matches:
            for n, to in self.automaton.places[state]:
                if n >= self.n_phrases:
                    per.setdefault(n, []).append((end, to, length))
        spans = []
        for n, found in per.items():
            found.sort()
            longest, gap = max(x[2] for x in found), min(MAX_GAP, self.sizes[n] // 5)
            best: list[tuple[int, int, int]] = []  # words covered by the best chain to each match, where it begins, its deciding phrases
            low = 0
            for k, (end, to, length) in enumerate(found):
                while found[low][0] < end - 2 * longest - gap:
                    low += 1
                held = sum(1 << d for d, (a, b) in enumerate(self.deciding[n]) if to - length <= a and b <= to)
                value = (length, -(end - length), held)
                for j in range(low, k):
                    e, t, _ = found[j]
                    overlap = max(0, e - (end - length), t - (to - length))
                    if e < end and t < to and overlap < length and end - length + overlap - e <= gap:
                        value = max(value, (best[j][0] + length - overlap, best[j][1], best[j][2] | held))
                best.append(value)
            for (end, _, _), (covered, begin, held) in zip(found, best, strict=True):
                if (share := covered / self.sizes[n]) >= MIN_COVERED and held == (1 << len(self.deciding[n])) - 1:
                    spans.append({"label": self.labels[n], "template": n - self.n_phrases, "first": -begin, "last": end - 1, "covered": min(1.0, share)})
        widest: dict[tuple[int, int], dict] = {}
        for s in spans:  # of chains with the same template and begin, the one that covers most
            key = s["template"], s["first"]
            if key not in widest or (s["covered"], -s["last"]) > (widest[key]["covered"], -widest[key]["last"]):
                widest[key] = s
        return list(widest.values())

    def _apart(self, spans: list[dict], n_words: int) -> list[dict]:
        """The spans without those that overlap one of another label which covers more words."""
        if len({s["label"] for s in spans}) > 1:
            names = sorted({s["label"] for s in spans})
            owner, kept = np.zeros(n_words, np.int16), []
            for s in sorted(spans, key=lambda s: (-s["covered"] * self.sizes[s["template"] + self.n_phrases], -s["covered"], s["first"], s["label"])):
                here, mine = owner[s["first"] : s["last"] + 1], names.index(s["label"]) + 1
                if not ((here != 0) & (here != mine)).any():
                    here[:] = mine
                    kept.append(s)
            spans = kept
        return sorted(spans, key=lambda s: (s["first"], s["last"], s["template"]))


def _words(text: str) -> list[str]:
    """The words of a template, by the rule for texts."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))


def _place(words: list[str], phrase: list[str]) -> tuple[int, int]:
    """Where a deciding phrase stands in its template."""
    for i in range(len(words) - len(phrase) + 1):
        if words[i : i + len(phrase)] == phrase:
            return i, i + len(phrase)
    raise ValueError(f"a template lacks its deciding phrase {' '.join(phrase)!r}")


def templates_of(table: DataFrame, most_mb: int = 16) -> list[tuple[str, str, tuple[str, ...]]]:
    """Templates of a table (label, text, deciding array<string>) of whole licence texts, whose size is checked before it is collected."""
    size = table.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > most_mb << 20:
        raise ValueError(f"licence texts of {size} bytes are more than {most_mb} MB")
    rows = table.select("label", "text", F.coalesce("deciding", F.array().cast("array<string>")).alias("deciding")).orderBy("label", "text").collect()
    return [(r.label, r.text, tuple(r.deciding)) for r in rows if r.label is not None and r.text]


@lru_cache(maxsize=2)
def _scanner(phrases: tuple, templates: tuple) -> Scanner:
    return Scanner(dict(phrases), list(templates))


_SPANS = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("template", T.LongType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("covered", T.DoubleType())]))
_RESULT = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")]
    + [T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", _SPANS)]
)
_ARROW = pa.struct(
    [(c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")]
    + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("template", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.float64())])))]
)


def scan_licences(docs: DataFrame, keep: list[str], text: str = "text", phrases: Mapping[str, str] = PHRASES, templates: list[tuple[str, str, tuple[str, ...]]] = TEMPLATES) -> DataFrame:
    """The columns `keep` with n_words, n_base, first_word, last_word, base_labels, labels, score and spans (words from 0, ends inclusive)."""
    key = tuple(phrases.items()), tuple(templates)
    keep = [c for c in keep if c not in _RESULT.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(*key)
        for batch in batches:
            records = [r for _, _, data, offsets in chunks(batch.column(text)) for r in scanner.scan(data, offsets)]
            found = pa.array(records, _ARROW)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pc.struct_field(found, c) for c in _RESULT.names)], [*keep, *_RESULT.names])

    return map_texts(docs.select(*dict.fromkeys([*keep, text])), run, T.StructType([*(docs.schema[c] for c in keep), *_RESULT.fields]))


#: The base columns: words, and the places of the phrases.
BASE_SQL = rf"""
with worded as (
  select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), phrases as (
  select string_split(phrase, ' ') as p, label from (values {', '.join(f"('{p}', '{label}')" for p, label in PHRASES.items())}) as t(phrase, label)
), places as (
  select rid, i - 1 as place, label from (select rid, w, p, label, unnest(range(1, len(w) - len(p) + 2)) as i from worded, phrases where list_has_all(w, p)) where w[i:i + len(p) - 1] = p
)
select doc_id, len(w)::bigint as n_words, count(place) as n_base, min(place) as first_word, max(place) as last_word, coalesce(string_agg(distinct label, ',' order by label), '') as base_labels
from worded left join places using (rid) group by rid, doc_id, w
"""
