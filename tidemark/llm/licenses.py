"""Licence scans: a generalised suffix automaton of templates, matching statistics, chained spans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, pieces, word_hashes, word_spans

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# The notices as their licences word them.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-2": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd-3": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "bsd-2": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "gpl-2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "agpl-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "bsl-1": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "epl-2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}
#: Parts of whole licence texts that stand without the notice.
BODIES = {
    "mit": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "apache-2": [
        "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. \"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License. \"Legal Entity\" shall mean the union of the acting entity and all other entities that control, are controlled by, or are under common control with that entity.",
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ],
    "gpl-3": [
        "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users.",
    ],
    "gpl-2": [
        "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users. This General Public License applies to most of the Free Software Foundation's software and to any other program whose authors commit to using it.",
    ],
    "bsl-1": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
}
#: The Creative Commons notices: what they add to attribution, and how their versions are worded.
CC_TERMS = ["", "-ShareAlike", "-NonCommercial", "-NoDerivatives", "-NonCommercial-ShareAlike", "-NonCommercial-NoDerivatives"]
CC_SHORT = ["cc-by", "cc-by-sa", "cc-by-nc", "cc-by-nd", "cc-by-nc-sa", "cc-by-nc-nd"]
CC_VERSIONS = {"": "4.0 International", "-3": "3.0 Unported"}


def all_templates() -> dict[str, list[str]]:
    """The texts of each label: notices and parts of bodies."""
    out = {label: [text, *BODIES.get(label, ())] for label, text in TEMPLATES.items()}
    for short, terms in zip(CC_SHORT, CC_TERMS):
        for end, version in CC_VERSIONS.items():
            out[short + end] = [f"This work is licensed under a Creative Commons Attribution{terms} {version} License."]
    return out


#: Bytes that part tokens: all ASCII but digits and letters.
_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def tokens(text: str) -> list[bytes]:
    low = _LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = word_spans(low, np.array([0, len(low)]), _GAP)
    return [low[a:b].tobytes() for a, b in zip(starts, ends)]


class SuffixAutomaton:
    """All runs of tokens of several sequences; each state knows where in which sequences it ends."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, list[int]]] = [{}]
        for number, sequence in enumerate(sequences):
            last = 0
            for place, token in enumerate(sequence):
                last = self._extend(last, token)
                self.ends[last].setdefault(number, []).append(place)
        # what ends somewhere, its suffixes end there too
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            for number, places in self.ends[state].items():
                above = self.ends[self.link[state]]
                above[number] = sorted({*above.get(number, ()), *places})

    def _new(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.ends.append({})
        return len(self.link) - 1

    def _split(self, state: int, target: int, token: int) -> int:
        """A state for the part of target that is reached from state alone."""
        half = self._new(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = half
        while state >= 0 and self.next[state].get(token) == target:
            self.next[state][token] = half
            state = self.link[state]
        return half

    def _extend(self, last: int, token: int) -> int:
        if (target := self.next[last].get(token)) is not None:  # a former sequence has it
            return target if self.length[target] == self.length[last] + 1 else self._split(last, target, token)
        new, state = self._new(self.length[last] + 1, {}, 0), last
        while state >= 0 and token not in self.next[state]:
            self.next[state][token] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][token]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._split(state, target, token)
        return new

    def statistics(self, ids: list[int]):
        """State and length of the longest match that ends at each token."""
        state = length = 0
        for token in ids:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.next[state]:
                state, length = self.next[state][token], length + 1
            yield state, length


class Scanner:
    """Finds templates, given as one text or several for each label.

    A stretch that covers enough of a template is not yet that template, as others may share most of it. So for each other label's
    template that has a fifth of its token pairs, those pairs that the other lacks must be covered as well.
    """

    def __init__(self, templates: dict[str, str | list[str]], phrases: dict[str, str], least_match: int = 4, most_gap: int = 12, coverage: float = 0.6, near: float = 0.2):
        self.least_match, self.most_gap, self.coverage = least_match, most_gap, coverage
        listed = [(label, t) for label, texts in templates.items() for t in ([texts] if isinstance(texts, str) else texts)]
        self.labels, cut = [label for label, _ in listed], [tokens(t) for _, t in listed]
        self.lengths = [len(c) for c in cut]
        pairs = [list(zip(c, c[1:])) for c in cut]
        self.telling: list[list[set[int]]] = []
        for label, mine in zip(self.labels, pairs):
            others = [set(p) for other, p in zip(self.labels, pairs) if other != label]
            apart = [{i for i, pair in enumerate(mine) if pair not in o} for o in others if len(set(mine) & o) >= near * len(set(mine))]
            self.telling.append([set(d) for d in {frozenset(a) for a in apart if a}])
        asked = [(tokens(p), label) for p, label in phrases.items()]
        words = sorted({w for c in [*cut, *(p for p, _ in asked)] for w in c})
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        hashes = word_hashes(data, ends - [len(w) for w in words], ends)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order + 1
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        number = {w: i + 1 for i, w in enumerate(words)}
        self.phrases = [([number[w] for w in p], label) for p, label in asked]
        numbered = [[number[w] for w in c] for c in cut]
        self.automaton = SuffixAutomaton(numbered)
        self.sequences = [[*c, -1] for c in numbered]
        self.aligned: dict[int, list] = {}

    def numbered(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the words of templates and phrases, 0 for any other."""
        out = np.zeros(len(hashes), np.int32)
        some = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[some]), len(self.hashes) - 1)
        same = self.hashes[at] == hashes[some]
        out[some[same]] = self.ids[at[same]]
        return out

    def places(self, ids: np.ndarray, first: np.ndarray, phrase: list[int]) -> np.ndarray:
        """Where the phrase's words stand one after the other within one text."""
        at = np.flatnonzero(ids[: max(0, len(ids) - len(phrase) + 1)] == phrase[0])
        for k, token in enumerate(phrase[1:], 1):
            at = at[ids[at + k] == token]
        return at[np.searchsorted(first, at, "right") == np.searchsorted(first, at + len(phrase) - 1, "right")]

    def _aligned(self, state: int) -> list[tuple[int, int, int | None]]:
        """template, its token, length of the match that ends there, for a state and the shorter matches that it has in it; None for the whole."""
        held = self.aligned.get(state)
        if held is None:
            own, seen, held = state, set(), []
            while state > 0 and (state == own or self.automaton.length[state] >= self.least_match):
                fresh = [(t, end) for t, ends in self.automaton.ends[state].items() for end in ends if (t, end) not in seen]
                seen.update(fresh)
                held += [(t, end, None if state == own else self.automaton.length[state]) for t, end in fresh]
                state = self.automaton.link[state]
            self.aligned[own] = held
        return held

    def matches(self, ids: np.ndarray, start: int) -> list[tuple[int, int, int, int]]:
        """template, its first token, the text's first token, length: matches of least_match that can't go on in their template."""
        found, listed = [], ids.tolist()
        for i, (state, length) in enumerate(self.automaton.statistics(listed)):
            if length >= self.least_match:
                following = listed[i + 1] if i + 1 < len(listed) else 0
                for t, end, n in self._aligned(state):
                    if self.sequences[t][end + 1] != following:
                        n = length if n is None else n
                        found.append((t, end - n + 1, start + i - n + 1, n))
        return found

    def spans(self, found: list[tuple[int, int, int, int]]) -> list[tuple[str, int, int, float]]:
        """label, first and last token, coverage of each stretch that covers enough of a template.

        Per template, matches in order of the text are chained over small gaps in text and template, each to the best
        chain that ends shortly before it (or goes on along its diagonal); chains that ended more than most_gap before
        are not looked at again. Of chains that share a match the one that covers most stays, and of stretches of
        several templates that overlap by half or more the one that covers most tokens, then the larger part, then
        the first by label.
        """
        best: list[tuple[int, float, str, int, int]] = []  # tokens covered, share, label, first and last token
        for t in sorted({m[0] for m in found}):
            matches = sorted((at, place, length) for x, place, at, length in found if x == t)
            covered, before, live = [], [], []
            for i, (at, place, length) in enumerate(matches):
                live = [j for j in live if matches[j][0] + matches[j][2] + self.most_gap >= at]
                score, link = length, -1
                for j in live:
                    at_j, place_j, length_j = matches[j]
                    if at - place == at_j - place_j:  # one diagonal
                        fresh = at + length - max(at, at_j + length_j)
                    else:
                        fresh = length if 0 <= at - at_j - length_j and 0 <= place - place_j - length_j <= self.most_gap else 0
                    if fresh > 0 and covered[j] + fresh > score:
                        score, link = covered[j] + fresh, j
                covered.append(score)
                before.append(link)
                live.append(i)
            used = [False] * len(matches)
            for i in sorted(range(len(matches)), key=lambda i: (-covered[i], i)):
                if covered[i] < self.coverage * self.lengths[t]:
                    break
                chain = [i]
                while not used[chain[-1]] and before[chain[-1]] >= 0:
                    chain.append(before[chain[-1]])
                if not any(used[j] for j in chain) and self._told(t, [matches[j] for j in chain]):
                    best.append((covered[i], min(1.0, covered[i] / self.lengths[t]), self.labels[t], matches[chain[-1]][0], matches[i][0] + matches[i][2] - 1))
                for j in chain:
                    used[j] = True
        return self._apart(best)

    def _told(self, t: int, chain: list[tuple[int, int, int]]) -> bool:
        """Whether the chain's matches cover enough of what sets the template apart from each that is like it."""
        if not self.telling[t]:
            return True
        covered = {p for _, place, length in chain for p in range(place, place + length - 1)}
        return all(len(d & covered) >= self.coverage * len(d) for d in self.telling[t])

    def _apart(self, best: list[tuple[int, float, str, int, int]]) -> list[tuple[str, int, int, float]]:
        """The stretches that no better one overlaps by half or more of the shorter."""
        best.sort(key=lambda b: (b[3], b[4]))
        lost, live = [False] * len(best), []
        for i, (covered, share, label, first, last) in enumerate(best):
            live = [j for j in live if best[j][4] >= first]
            for j in live:
                shared = min(last, best[j][4]) - first + 1
                if 2 * shared >= min(last - first, best[j][4] - best[j][3]) + 1:
                    worse = i if (-best[j][0], -best[j][1], best[j][2]) <= (-covered, -share, label) else j
                    lost[worse] = True
            live.append(i)
        return [(label, first, last, share) for (_, share, label, first, last), gone in zip(best, lost) if not gone]


def scan(docs: DataFrame, keep: list[str], templates: dict[str, str | list[str]] | None = None, phrases: dict[str, str] = PHRASES, text_col: str = "text", **how) -> DataFrame:
    """`keep`, n_words, n_base, first_word, last_word, base_labels, labels, score and spans of each row.

    Base places are where a phrase's words stand one after the other; labels has base_labels and the labels
    of spans, stretches whose chained matches cover enough of a template and of what tells it from others. score is 1 where there is a
    base place, else the best coverage (0 without a span). Null text counts as empty; every row is judged by
    itself, so repeated rows get equal results; an empty table gives no rows; columns not in `keep` are ignored
    whatever their names. A text is scanned whole, in time and memory in proportion to its length.

    The templates go to every task with the function: they are a parameter, bounded by who writes it.
    """
    picked = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("_text"), *[F.col(f"`{c}`").alias(f"_keep{i}") for i, c in enumerate(keep)])
    spans_type = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("coverage", pa.float64())]))
    extra = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label string, first long, last long, coverage double>>"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema[1:]), extra])
    names = [*picked.columns[1:], "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    joined = lambda labels: ",".join(sorted(labels))

    def run(batches):
        scanner = Scanner(templates or all_templates(), phrases, **how)
        for batch in batches:
            lengths = np.diff(bytes_of(batch.column(0))[1])
            for a, b in pieces(lengths, 8 << 20):
                data, offsets = bytes_of(batch.column(0).slice(a, b - a))
                low = _LOWER[data]
                starts, ends, first = word_spans(low, offsets, _GAP)
                ids = scanner.numbered(word_hashes(low, starts, ends))
                n = b - a
                n_base, base, more, best, spans = np.zeros(n, np.int64), [set() for _ in range(n)], [set() for _ in range(n)], np.zeros(n), [[] for _ in range(n)]
                lo, hi = [None] * n, [None] * n
                for phrase, label in scanner.phrases:
                    at = scanner.places(ids, first[:-1], phrase)
                    for place, doc in zip(at.tolist(), (np.searchsorted(first, at, "right") - 1).tolist()):
                        w = place - int(first[doc])
                        n_base[doc] += 1
                        base[doc].add(label)
                        lo[doc], hi[doc] = w if lo[doc] is None else min(lo[doc], w), w if hi[doc] is None else max(hi[doc], w)
                # stretches of template words within a text, long enough for a match
                known = ids > 0
                edge = np.zeros(len(ids) + 1, bool)
                edge[first] = True
                begin = np.flatnonzero(known & (edge[:-1] | ~np.concatenate([[False], known[:-1]])))
                finish = np.flatnonzero(known & (edge[1:] | ~np.concatenate([known[1:], [False]]))) + 1
                long = finish - begin >= scanner.least_match
                found: dict[int, list] = {}
                for x, y in zip(begin[long].tolist(), finish[long].tolist()):
                    if got := scanner.matches(ids[x:y], x):
                        found.setdefault(int(np.searchsorted(first, x, "right")) - 1, []).extend(got)
                for doc, got in found.items():
                    for label, x, y, part in scanner.spans(got):
                        more[doc].add(label)
                        best[doc] = max(best[doc], min(part, 1.0))
                        spans[doc].append({"label": label, "first": x - int(first[doc]), "last": y - int(first[doc]), "coverage": part})
                score = np.where(n_base > 0, 1.0, best)
                columns = [pa.array(np.diff(first)), pa.array(n_base), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array([joined(x) for x in base]), pa.array([joined(x | y) for x, y in zip(base, more)]), pa.array(score), pa.array(spans, spans_type)]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, n) for c in batch.columns[1:]), *columns], names)

    found = picked.mapInArrow(run, schema)
    return found.select(*[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)], *names[len(keep) :])
