"""License scan: exact seeds by the pigeonhole rule locate candidates, bounded-error matching verifies them.

A notice with at most ``k`` edits holds one of the notice's ``k + 1`` pieces unchanged. An automaton over all pieces
finds them in one pass; around each hit the notice is matched with at most ``k`` errors and the best span is reported.
Texts are matched as their words in lower case, joined by single spaces.

Defined results: a null text counts as empty and gives zero counts, null places, empty labels and score 0; repeated
rows and null ids give a row each; an empty table gives an empty result; other columns are ignored; texts of any length
are searched whole, and only the neighbourhood of a seed is ever matched.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from functools import cache
from itertools import accumulate

from pyspark.sql import DataFrame

from timeloom.llm._shared import map_texts

#: Phrases whose exact places make the base result, with their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Notices matched with edits: text, label, most edits.
NOTICES = (
    ("released under the mit license", "mit", 3),
    ("licensed under the apache license version 2 0", "apache-2", 4),
    ("licensed under cc by nc 4 0", "cc-by-nc", 2),
    ("licensed under the gnu general public license version 3", "gpl-3", 5),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("redistribution and use in source and binary forms with or without modification", "bsd", 6),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-2", 6),
    ("licensed under the gnu general public license version 2", "gpl-2", 4),
    ("licensed under the gnu lesser general public license", "lgpl", 5),
    ("licensed under the gnu affero general public license", "agpl-3", 5),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc", 8),
    ("this is free and unencumbered software released into the public domain", "unlicense", 6),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4", 5),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa-4", 6),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc", 6),
    ("has waived all copyright and related or neighboring rights to this work", "cc0", 6),
    ("boost software license version 1 0", "bsl-1", 2),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable", "zlib", 8),
    ("made available under the terms of the eclipse public license", "epl-2", 5),
    ("subject to the terms of the common development and distribution license", "cddl", 6),
    ("licensed under the european union public licence", "eupl", 4),
    ("distributed under the terms of the artistic license 2 0", "artistic-2", 4),
    ("do what the fuck you want to public license", "wtfpl", 3),
)


def in_step(hits: list[tuple[int, int]], within: int, least: int) -> list[int]:
    """The places, sorted, of hits (place, piece) that lie with ``least`` different pieces in a window no longer than ``within``."""
    hits = sorted(set(hits))
    good, low, marked, count = set(), 0, 0, Counter()
    for i, (at, piece) in enumerate(hits):
        count[piece] += 1
        while at - hits[low][0] > within:
            count[hits[low][1]] -= 1
            if not count[hits[low][1]]:
                del count[hits[low][1]]
            low += 1
        if len(count) >= least:
            good.update(h[0] for h in hits[max(low, marked) : i + 1])
            marked = i + 1
    return sorted(good)


class Finder:
    """The compiled notices of one Python process."""

    def __init__(self):
        import ahocorasick
        import regex

        lowered = {b: b + 32 for b in range(0x41, 0x5B)}
        word = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
        self.table = bytes(lowered.get(b, b) if lowered.get(b, b) in word else 0x20 for b in range(256))
        self.notices = [(p, label, 0) for p, label in PHRASES] + list(NOTICES)
        self.patterns = [regex.compile(f"(?be)(?<![^ ])(?:{regex.escape(text, literal_spaces=True)}){{e<={k}}}(?![^ ])") if k else None for text, _, k in self.notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for n, (text, _, k) in enumerate(self.notices):
            pieces = self.pieces(n)
            cuts = [len(text) * i // pieces for i in range(pieces + 1)]
            for a, b in zip(cuts, cuts[1:]):
                seeds.setdefault(text[a:b], []).append((n, a))
        self.seeds = ahocorasick.Automaton()
        for seed, uses in seeds.items():
            self.seeds.add_word(seed, (len(seed), uses))
        self.seeds.make_automaton()

    def pieces(self, n: int) -> int:
        """Pieces that a notice is cut into: up to twice as many as it may have edits, as long as they have six characters."""
        text, _, k = self.notices[n]
        return max(k + 1, min(2 * k + 2, len(text) // 6)) if k else 1

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """Notice, start, end and edits of every place in a normalised text, by notice and start.

        ``k`` edits leave all but ``k`` pieces as they are, and move them by no more than ``k`` against each other: only where so many
        are found in step is a match looked for, so a text full of one phrase of a notice costs no matching.
        """
        around: dict[int, list[tuple[int, int]]] = {}
        for last, (n_seed, uses) in self.seeds.iter(text):
            for n, offset in uses:
                start, k = last + 1 - n_seed - offset, self.notices[n][2]
                end = start + len(self.notices[n][0])
                if k:
                    around.setdefault(n, []).append((start, offset))
                elif text[max(0, start - 1) : start] in ("", " ") and text[end : end + 1] in ("", " "):
                    around.setdefault(n, []).append((start, end))
        found = []
        for n, spans in around.items():
            if not self.notices[n][2]:
                found += [(n, a, b, 0) for a, b in spans]
                continue
            size, k = len(self.notices[n][0]), self.notices[n][2]
            spans = [(start - k, start + size + k) for start in in_step(spans, k, self.pieces(n) - k)]
            if not spans:
                continue
            merged = [list(spans[0])]
            for a, b in spans[1:]:
                if a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            for a, b in merged:
                # the neighbourhood starts and ends at borders of words, so that a match can't end inside one
                a, b = text.rfind(" ", 0, max(0, a)) + 1, text.find(" ", b)
                found += [(n, m.start(), m.end(), sum(m.fuzzy_counts)) for m in self.patterns[n].finditer(text, a, len(text) if b < 0 else b)]
        return sorted(m for m in set(found) if m[0] < len(PHRASES)) + self.best([m for m in set(found) if m[0] >= len(PHRASES)])

    def best(self, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Of matches that overlap, that with the least share of edits (then the longest): one place has one notice."""
        kept: list[tuple[int, int, int, int]] = []  # start, end, notice, edits; by start
        for n, a, b, e in sorted(found, key=lambda m: (m[3] / len(self.notices[m[0]][0]), m[1] - m[2], m[1], m[0])):
            at = bisect_right(kept, (a,))
            if (at == 0 or kept[at - 1][1] <= a) and (at == len(kept) or kept[at][0] >= b):
                kept.insert(at, (a, b, n, e))
        return sorted((n, a, b, e) for a, b, n, e in kept)


@cache
def finder() -> Finder:
    return Finder()


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans``.

    ``spans`` lists label:first word:last word (exclusive):edits of the verified notices; ``score`` is the best share
    of unchanged characters among them, 0 without any.
    """

    def make(texts):
        find, rows = finder(), []
        for text in texts.to_pylist():
            words = (text or "").encode().translate(find.table).split()
            joined = b" ".join(words).decode()
            places = find.find(joined)
            base = [(n, a, b) for n, a, b, _ in places if n < len(PHRASES)]
            # a place's word is found among the ends of all words
            ends = list(accumulate(len(w) + 1 for w in joined.split(" "))) if places else []
            starts = [bisect_right(ends, a) for _, a, _ in base]
            score = max((1 - e / len(find.notices[n][0]) for n, _, _, e in places), default=0.0)
            spans = ",".join(f"{find.notices[n][1]}:{bisect_right(ends, a)}:{bisect_right(ends, b - 1) + 1}:{e}" for n, a, b, e in places if n >= len(PHRASES))
            name = lambda found: ",".join(sorted({find.notices[x[0]][1] for x in found}))
            rows.append((len(words), len(base), min(starts, default=None), max(starts, default=None), name(base), name(places), score, spans))
        return [list(c) for c in zip(*rows)] if rows else [[]] * 8

    return map_texts(docs, ["doc_id"], make, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")
