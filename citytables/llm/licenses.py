"""License scan: fuzzy search of short notices.

Texts become words. A phrase that may differ by e edits is split into e + 1 pieces, one of which
must occur unchanged in any match (pigeonhole), so an automaton over all pieces finds the places
to look at; there the regex library's bounded-error matching verifies the phrase and reports its
span. Base phrases must stand word by word, without an edit; they go the same way with one piece.

A notice must begin and end with a word. A null or empty text has no words and no match. Long texts are
scanned whole; repeated rows are rows of their own; an empty table gives an empty result; further columns are
ignored. Ties: of overlapping matches of one phrase that with the fewest edits counts, then the first.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from citytables.llm.common import lower_ascii, pieces

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Phrases of the base and their labels; no edits.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Short notices of the method: phrase, label, edits allowed (in characters).
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 4),
    ("the software is provided as is without warranty of any kind", "mit", 3),
    ("licensed under the mit license", "mit", 2),
    ("licensed under the apache license version 2 0", "apache", 3),
    ("apache software license", "apache", 1),
    ("gnu general public license", "gpl", 2),
    ("gnu lesser general public license", "lgpl", 2),
    ("gnu affero general public license", "agpl", 2),
    ("redistribution and use in source and binary forms with or without modification", "bsd", 4),
    ("bsd 3 clause license", "bsd", 1),
    ("mozilla public license", "mpl", 1),
    ("creative commons attribution", "cc", 1),
    ("this is free and unencumbered software released into the public domain", "unlicense", 4),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", 4),
    ("boost software license", "boost", 1),
    ("all rights reserved", "proprietary", 1),
)


def seeds(phrase: str, edits: int) -> list[tuple[str, int]]:
    """edits + 1 pieces of nearly equal length that make up the phrase, each with its start."""
    n = edits + 1
    cuts = [len(phrase) * i // n for i in range(n + 1)]
    return [(phrase[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    def __init__(self, base=BASE, notices=NOTICES):
        import ahocorasick

        self.rules = [(p, label, 0, True) for p, label in base] + [(p, label, e, False) for p, label, e in notices]
        # the spaces around are free of edits, so a match is whole words
        self.patterns = [regex.compile(f"(?e) (?:{regex.escape(p)}){{e<={e}}} ") for p, _, e, _ in self.rules]
        self.automaton = ahocorasick.Automaton()
        found: dict[str, list] = {}
        for i, (p, _, e, _) in enumerate(self.rules):
            for piece, at in seeds(p, e):
                found.setdefault(piece, []).append((i, at))
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def spans(self, line: str) -> list[tuple[int, int, int, int]]:
        """(rule, first character, end, edits) of every match in a line of words with one space between and around.

        Matches begin and end with a word. Around every seed the regex library looks for the phrase; of matches
        of one rule that overlap only the best counts: fewest edits, then the first, then the longest.
        """
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (length, where) in self.automaton.iter(line):
            for i, at in where:
                p, _, e, _ = self.rules[i]
                start = end - length + 1 - at
                windows.setdefault(i, []).append((max(0, start - e), start + len(p) + e))
        out = []
        for i, own in windows.items():
            if self.rules[i][3]:  # the seed is the whole phrase; it must begin and end with a word
                out += [(i, a, b, 0) for a, b in dict.fromkeys(own) if line[a - 1] == " " and line[b] == " "]
                continue
            found = {}
            for a, b in dict.fromkeys(own):
                for m in self.patterns[i].finditer(line, max(0, a - 1), min(len(line), b + 1), overlapped=True):
                    found[m.start() + 1, m.end() - 1] = sum(m.fuzzy_counts)
            taken: list[tuple[int, int]] = []
            for (a, b), edits in sorted(found.items(), key=lambda x: (x[1], x[0][0], -x[0][1])):
                at = bisect.bisect_left(taken, (a, b))
                if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or taken[at][0] >= b):
                    taken.insert(at, (a, b))
                    out.append((i, a, b, edits))
        return sorted(out, key=lambda s: (s[1], s[2], s[0]))


@lru_cache(maxsize=4)
def scanner(base=BASE, notices=NOTICES) -> Scanner:
    return Scanner(base, notices)


def scan(text: str | None, base=BASE, notices=NOTICES) -> tuple[int, list[tuple[str, str, int, int, int, bool]]]:
    """Number of words, and the matches: phrase, label, first word, last word, edits, whether it is a base place."""
    words = WORD.findall(lower_ascii(text or ""))
    if not words:
        return 0, []
    own = scanner(base, notices)
    line = f" {' '.join(words)} "
    spans = own.spans(line)
    if not spans:
        return len(words), []
    starts, at = [], 1
    for w in words:
        starts.append(at)
        at += len(w) + 1
    found = []
    for i, a, b, edits in spans:
        phrase, label, _, exact = own.rules[i]
        first = max(0, bisect.bisect_right(starts, a) - 1)
        last = max(first, bisect.bisect_left(starts, b) - 1)
        found.append((phrase, label, first, last, edits, exact))
    return len(words), found


_OUT = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("phrase", pa.string()), ("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("base", pa.bool_())]))),
    ]
)
SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<phrase:string,label:string,first_word:bigint,last_word:bigint,edits:int,base:boolean>>"


def _score(found: list) -> float:
    """1 for a base place, else the best share of characters of a notice that match, 0 without one."""
    return max((1.0 if exact else max(0.0, 1 - edits / len(phrase)) for phrase, _, _, _, edits, exact in found), default=0.0)


def _scanned(base, notices):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                n, found = scan(text, base, notices)
                places = [f[2] for f in found if f[5]]
                rows.append(
                    {
                        "doc_id": doc, "n_words": n, "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
                        "base_labels": ",".join(sorted({f[1] for f in found if f[5]})), "labels": ",".join(sorted({f[1] for f in found})), "score": _score(found),
                        "spans": [dict(zip(("phrase", "label", "first_word", "last_word", "edits", "base"), f, strict=True)) for f in found],
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema=_OUT)

    return run


def license_scan(docs: DataFrame, base=BASE, notices=NOTICES) -> DataFrame:
    """Per document: counts, labels, score and the spans of all matches; no shuffle."""
    return docs.select("doc_id", "text").mapInArrow(_scanned(base, notices), SCHEMA)
