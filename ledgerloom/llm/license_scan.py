"""License scan: a generalised suffix automaton of licence tokens streams over each text."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import field, map_batches, per_text, plain, words_of

#: The phrases whose places are always reported, with their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices by which works name their licence, and texts of short licences, with the
#: labels they earn.
NOTICES: tuple[tuple[str, str], ...] = (
    ("mit", "released under the MIT license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software"
        " without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit"
        " persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies"
        " or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF"
        " MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,"
        " WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("apache-2.0", "licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License"),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS,"
        " WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("gpl-3.0", "this work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either"
        " version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the"
        " implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General"
        " Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    (
        "bsd-2-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code"
        " must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this"
        " list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND"
        " CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE"
        " DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT"
        " LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN"
        " CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "bsd-3-clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written"
        " permission.",
    ),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this"
        " permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF"
        " MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF"
        " USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."
        " Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following"
        " restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an"
        " acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as"
        " being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "licensed under CC BY 4.0"),
    ("cc-by-nc-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source"
        " code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
)

#: What a base phrase alone is worth: it names a licence, but may also say that it isn't this one.
PHRASE_SCORE = 0.5


class LicenseAutomaton:
    """Suffix automaton of several token sequences.

    A state stands for the substrings with one set of end places; ``ends`` lists those
    places as (template, end) and ``phrases`` the base phrases its substrings may end in.
    """

    def __init__(self, templates: Sequence[tuple[str, str]] = NOTICES, phrases: Mapping[str, str] = BASE_PHRASES):
        self.labels = [label for label, _ in templates]
        self.sizes = [len(words_of(text.encode())) for _, text in templates]
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        sequences = [words_of(text.encode()) for _, text in templates]
        base = [words_of(p.encode()) for p in phrases]
        self.phrase_labels = list(phrases.values())
        self.phrase_sizes = [len(p) for p in base]
        for sequence in [*sequences, *base]:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        self.vocabulary = frozenset(w for s in [*sequences, *base] for w in s)
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.next]
        self.phrases: list[list[int]] = [[] for _ in self.next]
        for t, sequence in enumerate(sequences):
            state = 0
            for i, word in enumerate(sequence):
                state = self.next[state][word]
                self.ends[state].append((t, i))
        for p, sequence in enumerate(base):
            state = 0
            for word in sequence:
                state = self.next[state][word]
            self.phrases[state].append(p)
        longest_first = sorted(range(1, len(self.next)), key=lambda s: -self.length[s])
        for s in longest_first:
            self.ends[self.link[s]].extend(self.ends[s])
        for s in reversed(longest_first):
            self.phrases[s].extend(self.phrases[self.link[s]])

    def _new(self, length: int, link: int, edges: dict[bytes, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, state: int, target: int, word: bytes) -> int:
        """The state for the substrings of ``target`` that are one longer than ``state``."""
        if self.length[target] == self.length[state] + 1:
            return target
        clone = self._new(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = clone
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, word: bytes) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return self._split(last, known, word)
        new = self._new(self.length[last] + 1, 0, {})
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, self.next[state][word], word)
        return new

    def scan(self, words: list[bytes], min_match: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Matching statistics of ``words``, of which are kept: the places (phrase, start) of
        base phrases, and the matches (end, length, state) of ``min_match`` words or more that
        the next word doesn't prolong."""
        vocabulary, nexts, link, length, phrases = self.vocabulary, self.next, self.link, self.length, self.phrases
        places: list[tuple[int, int]] = []
        long: list[tuple[int, int, int]] = []
        state = matched = 0
        before = -1
        for i in [i for i, w in enumerate(words) if w in vocabulary]:
            old_state, old = state, matched
            if i != before + 1:
                state = matched = 0
            target = nexts[state].get(words[i])
            while target is None and state:
                state = link[state]
                matched = length[state]
                target = nexts[state].get(words[i])
            if target is not None:
                state = target
                matched += 1
            if old >= min_match and matched != old + 1:
                long.append((before, old, old_state))
            before = i
            for p in phrases[state]:
                if matched >= self.phrase_sizes[p]:
                    places.append((p, i - self.phrase_sizes[p] + 1))
        if matched >= min_match:
            long.append((before, matched, state))
        return places, long

    def chains(self, long: list[tuple[int, int, int]], max_gap: int, min_cover: float = 0.6) -> list[tuple[int, int, int, int]]:
        """(template, first word, last word, template words covered) of the best chain in each
        cluster of matches that lie at most ``max_gap`` words apart, and of all that lie beside it and
        cover ``min_cover`` of the template too. A chain goes forward in the text and in the template
        at once; a Fenwick tree over the template finds what it prolongs."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for end, size, state in long:
            for t, at in self.ends[state]:
                by.setdefault(t, []).append((end - size + 1, end, at))
        found = []
        for t, matches in by.items():
            matches.sort()
            begin = 0
            for i in range(1, len(matches) + 1):
                if i == len(matches) or matches[i][0] - matches[i - 1][1] > max_gap:
                    found += [(t, *chain) for chain in self._chains_in(matches[begin:i], self.sizes[t], min_cover)]
                    begin = i
        return found

    @classmethod
    def _chains_in(cls, matches: list[tuple[int, int, int]], size: int, min_cover: float) -> Iterator[tuple[int, int, int]]:
        """The best chain of a cluster, then those before and after it. To stay near linear in the
        number of copies, these are looked for in a window that doubles until its best chain stays."""
        best = cls._best_chain(matches, size)
        yield best
        if best[2] / size < min_cover:
            return
        waiting = [[m for m in matches if m[1] < best[0]], [m for m in matches if m[0] > best[1]]]
        while waiting:
            part, at = waiting.pop(), 0
            while at < len(part):
                width = 64
                best = cls._best_chain(part[at : at + width], size)
                while at + width < len(part):
                    width *= 2
                    wider = cls._best_chain(part[at : at + width], size)
                    if wider == best and best[2] / size >= min_cover:
                        break
                    best = wider
                if best[2] / size < min_cover:
                    break
                yield best
                waiting.append([m for m in part[at : at + width] if m[1] < best[0]])
                at = bisect_right(part, best[1], at, key=lambda m: m[0])

    @staticmethod
    def _best_chain(matches: list[tuple[int, int, int]], size: int) -> tuple[int, int, int]:
        tree: list[tuple[int, int]] = [(0, -1)] * (size + 1)  # most words covered up to a place, where that chain began
        waiting = sorted(range(len(matches)), key=lambda i: matches[i][1])
        done: dict[int, tuple[int, int]] = {}
        best = (0, 0, 0)
        w = 0
        for i, (start, end, at) in enumerate(matches):
            while w < len(waiting) and matches[waiting[w]][1] < start:
                if waiting[w] in done:
                    k = matches[waiting[w]][2] + 1
                    while k <= size:
                        tree[k] = max(tree[k], done[waiting[w]])
                        k += k & -k
                w += 1
            words = end - start + 1
            k, chain = at - words + 1, (0, -1)
            while k > 0:
                chain = max(chain, tree[k])
                k -= k & -k
            first = start if chain[0] == 0 else -chain[1]
            done[i] = (chain[0] + words, -first)
            if (chain[0] + words, -first) > (best[2], -best[0]) or best[2] == 0:
                best = (first, end, chain[0] + words)
        return best


def scan_text(automaton: LicenseAutomaton, text: bytes, min_match: int = 4, min_cover: float = 0.6, max_gap: int = 40) -> tuple:
    words = words_of(text)
    places, long = automaton.scan(words, min_match)
    base = {automaton.phrase_labels[p] for p, _ in places}
    labels = set(base)
    cover = 0.0
    spans = []
    for t, first, last, covered in automaton.chains(long, max_gap, min_cover) if long else ():
        share = min(1.0, covered / automaton.sizes[t])
        cover = max(cover, share)
        if share >= min_cover:
            labels.add(automaton.labels[t])
            spans.append((first, last + 1, automaton.labels[t]))
    starts = [s for _, s in places]
    return (
        len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)),
        max(cover, PHRASE_SCORE if places else 0.0), ",".join(f"{label}:{a}:{b}" for a, b, label in outermost(spans)),
    )


def outermost(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Sorted and distinct, without those that lie in another span of their label."""
    out: list[tuple[int, int, str]] = []
    reach: dict[str, int] = {}
    for a, b, label in sorted(set(spans), key=lambda s: (s[0], -s[1], s[2])):
        if reach.get(label, -1) < b:
            out.append((a, b, label))
            reach[label] = b
    return sorted(out)


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[tuple[str, str]] = NOTICES,
    phrases: Mapping[str, str] = BASE_PHRASES, min_match: int = 4, min_cover: float = 0.6, max_gap: int = 40,
) -> DataFrame:
    """Licence labels of every whole text, one row for each row of ``docs``.

    Columns: the id, n_words, n_base (places of base phrases), first_word and last_word (their
    smallest and largest start, null without one), base_labels, labels, score and spans
    (``label:first:end`` in words, of chained matches that cover ``min_cover`` of a template; one
    that lies in another of its label is left out). The score is the largest share of a template
    that a chain covers, and ``PHRASE_SCORE`` at least where a base phrase stands. A match shorter
    than ``min_match`` words is no evidence.

    Null and empty texts have no words, empty labels and score 0; a null id stays null;
    repeated rows give repeated results; an empty table gives none; other columns are not read.
    The automaton's size is that of ``templates``, not of the data; each task holds one copy.
    """
    made = LicenseAutomaton(templates, phrases)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string()]
    long, text = T.LongType(), T.StringType()
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
    added = [field(n, k) for n, k in zip(names, (long, long, long, long, text, text, T.DoubleType(), text), strict=True)]
    source = plain(docs, id_col, text_col)
    return map_batches(source, added, lambda: per_text(lambda t: scan_text(made, t, min_match, min_cover, max_gap), kinds, text_col), [id_col])
