"""License scans: phrases that stand as consecutive words, and ordered signature rules.

An automaton runs over each text once; only rules whose literal is in it are tried. Detections are resolved by
priority: one that lies within another of at least its priority is suppressed (the longer one explains it).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, fold, utf8
from .license_rules import Rule, rules

#: Fixed phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_PLAIN = bytes(i if i >= 128 or chr(i) in "abcdefghijklmnopqrstuvwxyz0123456789.:/+-" else 32 for i in range(256))
SCORE = {3: 1.0, 2: 0.8, 1: 0.5}


#: Words that open the phrases.
OPENERS = ("gnu", "apache", "cc", "license")
BASE = -1


@cache
def literals() -> tuple[ahocorasick.Automaton, list[Rule]]:
    """The automaton yields, for each literal, the numbers of the rules that can't match without it."""
    every, opens = rules(), {w: {BASE} for w in OPENERS}
    for i, r in enumerate(every):
        opens.setdefault(r.literal, set()).add(i)
    automaton = ahocorasick.Automaton()
    for w, ids in opens.items():
        automaton.add_word(w, ids)
    automaton.make_automaton()
    return automaton, every


def plain(text: str) -> str:
    """The text in lower case in the form that the rules see."""
    return b" ".join(text.encode().translate(_PLAIN).split()).decode()


def opened(text: str) -> set[int]:
    numbers, seen = set(), set()
    for _, ids in literals()[0].iter(plain(text)):
        if id(ids) not in seen:
            seen.add(id(ids))
            numbers |= ids
    return numbers


def places(words: list[str]) -> list[tuple[int, str]]:
    """(first word, label) of every place of a phrase."""
    out = []
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        i = -1
        try:
            while True:
                i = words.index(parts[0], i + 1)
                if words[i : i + len(parts)] == parts:
                    out.append((i, label))
        except ValueError:
            pass
    return sorted(out)


def resolved(found: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Detections (start, end, priority, label) without those within another of at least their priority; of equals the first stays."""
    out, reach = [], {}
    for d in sorted(set(found), key=lambda d: (d[0], -d[1], -d[2], d[3])):
        if not any(level >= d[2] and far >= d[1] for level, far in reach.items()):
            out.append(d)
        reach[d[2]] = max(reach.get(d[2], 0), d[1])
    return out


def detections(text: str, numbers: set[int]) -> list[tuple[int, int, int, str]]:
    """What the opened rules find in the text, offsets in its normalised form."""
    seen, every = plain(text), literals()[1]
    return resolved([(m.start(), m.end(), every[i].priority, every[i].label) for i in sorted(numbers) if i >= 0 for m in every[i].regex.finditer(seen)])


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_detections long"


def scan(docs: DataFrame) -> DataFrame:
    """A row for each document: words, places of phrases, labels of both kinds, the best detection's score.

    Null text: empty, without words or labels. Repeated rows are scanned alike. An empty table gives an empty frame.
    Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            raw, at = utf8(b.column(1))
            word = _WORD[fold(raw)] if len(raw) else np.zeros(0, bool)
            first = word.copy()
            first[1:] &= ~word[:-1]
            inner = at[1:-1][at[1:-1] < len(raw)]
            first[inner] = word[inner]
            total = np.concatenate([[0], np.cumsum(first)])
            rows = []
            for doc, text, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), (total[at[1:]] - total[at[:-1]]).tolist()):
                small = text.translate(_SMALL) if not text.isascii() else text.lower()
                numbers = opened(small)
                base = places(WORDS.findall(small)) if BASE in numbers else []
                more = detections(small, numbers) if any(i >= 0 for i in numbers) else []
                own = sorted({label for _, label in base})
                labels = sorted({*own, *(d[3] for d in more)})
                score = 1.0 if base else max((SCORE[d[2]] for d in more), default=0.0)
                rows.append((doc, n, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(own), ",".join(labels), score, len(more)))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64()]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), types)], [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
