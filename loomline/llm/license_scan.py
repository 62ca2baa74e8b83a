"""Licence scans: a generalised suffix automaton over the words of licence templates.

Files are streamed through the automaton word by word; the state and the length of the match at each place are the
matching statistics: the longest run of words ending there that some template has. The suffix links below the state
give every template its own longest runs there, also those that a longer run of another template holds. Runs of
`MIN_MATCH` words or more that no word on either side prolongs are chained, template by template, in the order of the
template, into the spans that cover it; a template whose covered share reaches `MIN_COVER` gives its label. Templates
below `WHOLE` words must be matched whole, with at most `SHORT_GAP` other words between, and the runs in `DECIDING`,
which tell near-alike licences apart, unbroken in every template that has them. Of templates of different labels that match the same words, a whole
one goes before a partial one, then the one with more words. The base phrases are templates that must be matched whole.

The built-in templates are the grants and notices of the common licences, short licences whole; `templates_of` makes
templates of further texts, such as a folder of licence files that the caller has read.

A match of two words or more can only lie where neighbouring words are neighbours in a template, so the automaton
is stepped only through runs of such pairs, which numpy finds; the statistics are the same as for every word.

Cases: null counts as empty; a text without words has no places and score 0; repeated rows are scanned each; texts
of any length (memory: one text's words); phrases and templates without words match nothing, those of one word
wherever it stands. Words: `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z only.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns
from .license_texts import TEXTS

#: The operator's own base phrases and their labels; op4_license_scan brings those of its contract.
PHRASES = (("the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Label and wording of licences, grants and notices.
TEMPLATES = TEXTS

MIN_MATCH, MIN_COVER = 3, 0.8
#: Most words of the text between two matches of one chain.
MAX_GAP = 30
#: Templates of fewer words must be matched whole, with so many other words between at most.
WHOLE, SHORT_GAP = 12, 3
#: Runs that must stand unbroken in the match of a template that has them.
DECIDING = (
    "gnu general public license", "lesser general public license", "affero general public license", "mozilla public license v 2 0",
    "licenses license 2 0", "attribution 4 0 international",
)

_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20 for b in range(256))


def words(text: str) -> list[bytes]:
    """The words of a whole text, in UTF-8."""
    return text.encode("utf-8", "replace").translate(_WORD_BYTES).split()


@dataclass
class Automaton:
    """Suffix automaton of several word sequences; a state stands for the runs that end at the same places."""

    go: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    long: list[int] = field(default_factory=lambda: [0])
    ends: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])  #: (template, words up to here)

    def _state(self, go: dict[int, int], link: int, long: int, ends: set) -> int:
        self.go.append(go)
        self.link.append(link)
        self.long.append(long)
        self.ends.append(ends)
        return len(self.go) - 1

    def _clone(self, p: int, word: int, q: int) -> int:
        copy = self._state(dict(self.go[q]), self.link[q], self.long[p] + 1, set())
        self.link[q] = copy
        while p >= 0 and self.go[p].get(word) == q:
            self.go[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, template: int, sequence: Iterable[int]) -> None:
        last = 0
        for k, word in enumerate(sequence, 1):
            if word in self.go[last]:  # an earlier sequence has this run
                q = self.go[last][word]
                last = q if self.long[q] == self.long[last] + 1 else self._clone(last, word, q)
            else:
                p, now = last, self._state({}, 0, self.long[last] + 1, set())
                while p >= 0 and word not in self.go[p]:
                    self.go[p][word] = now
                    p = self.link[p]
                if p >= 0:
                    q = self.go[p][word]
                    self.link[now] = q if self.long[q] == self.long[p] + 1 else self._clone(p, word, q)
                last = now
            self.ends[last].add((template, k))

    def finish(self) -> None:
        """Hands the ends of each state to the shorter runs that end there too."""
        for s in sorted(range(1, len(self.go)), key=lambda s: -self.long[s]):
            self.ends[self.link[s]] |= self.ends[s]
        self._runs: dict[int, list[tuple[int, int, int]]] = {}

    def runs(self, state: int) -> list[tuple[int, int, int]]:
        """(template, words up to here, words of the run) of every place in a template that shares words with the state's run.

        Each place once, with its longest run; 0 words stand for the whole match, whose length the state alone does not tell.
        """
        found = self._runs.get(state)
        if found is None:
            found, seen, s = [(k, e, 0) for k, e in self.ends[state]], self.ends[state], self.link[state]
            while s > 0:
                found += [(k, e, self.long[s]) for k, e in self.ends[s] - seen]
                seen, s = self.ends[s], self.link[s]
            self._runs[state] = found
        return found

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """Matching statistics one word on."""
        while state and word not in self.go[state]:
            state = self.link[state]
            length = self.long[state]
        return (self.go[state][word], length + 1) if word in self.go[state] else (0, 0)


@dataclass(frozen=True)
class Chain:
    """Matches of one template in order: their places in the text (from, to), the words they cover, the deciding runs they hold."""

    template: int
    held: int
    cover: int
    places: tuple[tuple[int, int], ...]

    @property
    def first(self) -> int:
        return self.places[0][0]

    @property
    def last(self) -> int:
        return self.places[-1][1] - 1


#: A match: where it ends and starts in the text, where it starts in the template.
Match = tuple[int, int, int]


def _clipped(found: list[Match], lo: int, hi: int, longest: int) -> list[Match]:
    """What of the matches, in the order of their ends, lies from word `lo` up to `hi` of the text."""
    out = []
    for end, start, at in found[bisect_right(found, lo, key=lambda x: x[0]) :]:
        if end > hi + longest:
            break
        s, e = max(start, lo), min(end, hi)
        if s < e:
            out.append((e, s, at + s - start))
    return sorted(out)


class Scanner:
    def __init__(self, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES):
        texts = [(label, words(t)) for t, label in phrases] + [(label, words(t)) for label, t in templates]
        self.n_phrases, self.labels, self.size = len(phrases), [x for x, _ in texts], [len(t) for _, t in texts]
        self.number: dict[bytes, int] = {}
        for _, t in texts:
            for w in t:
                self.number.setdefault(w, len(self.number))
        coded = [[self.number[w] for w in t] for _, t in texts]
        self.coded, self.automaton = coded, Automaton()
        for k, t in enumerate(coded):
            self.automaton.add(k, t)
        self.automaton.finish()
        self.deciding = [[(i, i + len(d)) for d in map(words, DECIDING) for i in range(len(t) - len(d) + 1) if t[i : i + len(d)] == d] for _, t in texts]
        self.n = len(self.number)
        self.pairs = np.zeros((self.n + 1) ** 2, bool)
        for t in coded:
            for a, b in pairwise(t):
                self.pairs[a * (self.n + 1) + b] = True
        self.single = {t[0]: [k for k, u in enumerate(coded) if u == t] for t in coded if len(t) == 1}

    def matches(self, ws: Sequence[bytes]) -> tuple[list[tuple[int, int]], dict[int, list[Match]]]:
        """(first word, phrase) of every place of a phrase, and each template's matches in the order of their ends.

        A match is a run of `MIN_MATCH` words or more (or a template of fewer, whole) that text and template share and that
        neither the word before nor the one after prolongs; each place in the template is a match of its own.
        """
        get, n, a, sizes, coded = self.number.get, self.n, self.automaton, self.size, self.coded
        ids = np.fromiter((get(w, n) for w in ws), np.int64, len(ws))
        near = np.flatnonzero(self.pairs[ids[:-1] * (n + 1) + ids[1:]]) if len(ws) > 1 else np.empty(0, np.int64)
        places: list[tuple[int, int]] = []
        found: dict[int, list[Match]] = {}
        for word, ks in self.single.items():
            for i in np.flatnonzero(ids == word).tolist():
                for k in ks:
                    if k < self.n_phrases:
                        places.append((i, k))
                    else:
                        found.setdefault(k, []).append((i + 1, i, 0))
        for run in np.split(near, np.flatnonzero(np.diff(near) > 1) + 1) if len(near) else ():
            state = length = 0
            first, last = int(run[0]), int(run[-1]) + 1
            part = [*ids[first : last + 1].tolist(), n]  # no template goes on over the end of a run
            for i, word in enumerate(part[:-1], first + 1):
                state, length = a.step(state, length, word)
                if length < 2:
                    continue
                after = part[i - first]
                for k, upto, m in a.runs(state):
                    m = m or length
                    if k < self.n_phrases:
                        if upto == sizes[k] <= m and m > 1:
                            places.append((i - sizes[k], k))
                    elif m >= MIN_MATCH or m == sizes[k] > 1:
                        if upto == sizes[k] or coded[k][upto] != after:
                            found.setdefault(k, []).append((i, i - m, upto - m))
        return places, found

    def scan(self, text: str) -> dict:
        ws = words(text)
        places, by_template = self.matches(ws)
        by_template = {k: sorted(found) for k, found in by_template.items()}
        best = [self._best(k, found) for k, found in by_template.items()]
        labels = {self.labels[p] for _, p in places}
        taken = self._winners(c for k, found in by_template.items() for c in self._chains(k, found))
        starts = [s for s, _ in places]
        return {
            "n_words": len(ws),
            "n_base": len(places),
            "first_word": min(starts, default=None),
            "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(labels)),
            "labels": ",".join(sorted(labels | {self.labels[c.template] for c in taken})),
            "score": 1.0 if places else max((c.cover / self.size[c.template] for c in best), default=0.0),
            "spans": [(self.labels[c.template], c.first, c.last) for c in taken],
        }

    def _held(self, k: int, at: int, n: int, since: int = 0) -> int:
        """Deciding runs of a template that end after `since` and that a match of n words from `at` holds."""
        return sum(at <= a and since < b <= at + n for a, b in self.deciding[k])

    def _link(self, k: int, chains: list[tuple], match: Match, since: int) -> tuple:
        """The best chain that ends with a match: by deciding runs, by words covered, then the one that starts last.

        (deciding runs held, words covered, its start, chain before or -1, words of this match that it covers too, match). `chains` are
        those of the matches that end before, or there, from number `since` on.
        """
        end, start, at = match
        n = end - start
        top = (self._held(k, at, n), n, start, -1, 0, match)
        for j in range(len(chains) - 1, since - 1, -1):
            held, cover, first, _, _, (e, s, a) = chains[j]
            if start - e > MAX_GAP:
                break
            skip = max(0, a + e - s - at, e - start)
            if skip < n:
                top = max(top, (held + self._held(k, at, n, a + e - s), cover + n - skip, first, j, skip, match), key=lambda x: x[:3])
        return top

    def _chain(self, k: int, chains: list[tuple], i: int) -> Chain:
        held, cover = chains[i][:2]
        places = []
        while i >= 0:
            _, _, _, before, skip, (end, start, _) = chains[i]
            places.append((start + skip, end))
            i = before
        return Chain(k, held, cover, tuple(places[::-1]))

    def _best(self, k: int, found: list[Match]) -> Chain:
        chains: list[tuple] = []
        for m in found:
            chains.append(self._link(k, chains, m, 0))
        return self._chain(k, chains, max(range(len(chains)), key=lambda i: (*chains[i][:2], chains[i][2] - chains[i][5][0])))

    def _chains(self, k: int, found: list[Match]) -> list[Chain]:
        """As many disjoint chains that are enough as there are, each then as good as the room up to the next lets it be.

        Always taking the chain that is enough first gives most chains.
        """
        least: list[Chain] = []
        chains: list[tuple] = []
        since = lo = 0
        for end, start, at in found:
            if end <= lo:
                continue
            s = max(start, lo)
            chains.append(self._link(k, chains, (end, s, at + s - start), since))
            if chains[-1][1] >= MIN_COVER * self.size[k] and self._enough(c := self._chain(k, chains, len(chains) - 1)):
                least.append(c)
                since, lo = len(chains), c.last + 1
        out: list[Chain] = []
        for i, c in enumerate(least):
            room = _clipped(found, out[-1].last + 1 if out else 0, least[i + 1].first if i + 1 < len(least) else found[-1][0], self.size[k])
            best = self._best(k, room)
            out.append(best if self._enough(best) else c)
        return out

    def _enough(self, c: Chain) -> bool:
        n = self.size[c.template]
        least, extent = (n, n + SHORT_GAP) if n < WHOLE else (MIN_COVER * n, len(c.places) * (n + MAX_GAP))
        return c.cover >= least and c.last + 1 - c.first <= extent and c.held >= len(self.deciding[c.template])

    def _whole(self, c: Chain) -> bool:
        return c.last + 1 - c.first == c.cover == self.size[c.template]

    def _winners(self, chains: Iterable[Chain]) -> list[Chain]:
        """The chains without those that share `MIN_MATCH` words or more with a better one, or with one as good of their own label."""
        rank = {c: (self._whole(c), c.cover) for c in chains}
        out: list[Chain] = []
        at: dict[int, list[int]] = {}  # word of the text -> chains that hold it
        for c in sorted(rank, key=rank.get, reverse=True):
            covered = [w for a, b in c.places for w in range(a, b)]
            shared = Counter(o for w in covered for o in at.get(w, ()))
            if not any(n >= MIN_MATCH and (rank[out[o]] > rank[c] or self.labels[out[o].template] == self.labels[c.template]) for o, n in shared.items()):
                for w in covered:
                    at.setdefault(w, []).append(len(out))
                out.append(c)
        return sorted(out, key=lambda c: (c.template, c.first))


def templates_of(texts: Mapping[str, str]) -> list[tuple[str, str]]:
    """Templates of whole licence texts by label, as `scan_licenses` takes them; put them after TEMPLATES or in their place."""
    return [(label, text) for label, text in texts.items()]


def scan_licenses(documents: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, keep_text: bool = True) -> DataFrame:
    """documents with n_words, n_base, first_word, last_word, base_labels, labels, score and spans of each text."""
    span = T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])
    kinds = {"n_words": T.LongType(), "n_base": T.LongType(), "first_word": T.LongType(), "last_word": T.LongType(), "base_labels": T.StringType(), "labels": T.StringType(), "score": T.DoubleType(), "spans": T.ArrayType(span)}

    def make() -> Callable[[list[str]], list]:
        scanner = Scanner(phrases, templates)

        def work(texts: list[str]) -> list:
            found = [scanner.scan(t) for t in texts]
            out = [[f[k] for f in found] for k in kinds]
            out[-1] = [[dict(zip(("label", "first", "last"), s)) for s in spans] for spans in out[-1]]
            return out

        return work

    return append_columns(documents, "text", [T.StructField(k, t) for k, t in kinds.items()], make, keep_text)


def license_report(documents: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """The digest columns of every document."""
    return scan_licenses(documents.select("doc_id", "text"), phrases, templates, keep_text=False).drop("spans")
