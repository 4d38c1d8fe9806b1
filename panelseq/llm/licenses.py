"""Licence scan by template markup compiled to token automata.

A template is a line of words with two kinds of regions: ``[[words]]`` may be missing, ``{{name:a-b}}``
stands for any a to b words. Everything else is mandatory and has to be there word for word, in order, with
any bytes other than word bytes between. A compiled template is a nondeterministic automaton over word hashes, run
from each word that can begin it; the longest accepted run counts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelseq.llm.common import narrow, prefix_hash, range_hash, row_offsets, slices, text_bytes, word_hashes
from panelseq.session import ship

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = {
    "apache-2.0-notice": "licensed under the apache license version 2 [[0]]",
    "mit-notice": "released under [[the terms of]] the mit license",
    "gpl-notice": "licensed under [[the terms of]] the gnu [[lesser]] general public license [[version {{version:1-2}}]]",
    "cc-notice": "licensed under [[a]] cc by [[nc]] [[sa]] {{version:1-2}}",
    "copyright-notice": "copyright [[c]] {{owner:1-8}} all rights reserved",
}
BASE_SCORE, TEMPLATE_SCORE = 0.5, 1.0
_PART = re.compile(r"\[\[|\]\]|\{\{\w+:(\d+)-(\d+)\}\}|[^\s\[\]{}]+")


def word_hash(word: str) -> int:
    b = np.frombuffer(word.encode(), np.uint8)
    return int(range_hash(prefix_hash(b), np.array([0]), np.array([len(b)]))[0])


class Automaton:
    """States are numbers; ``moves[s]`` is a list of (word hash or None for any word, next state)."""

    def __init__(self, template: str) -> None:
        self.moves: list[list[tuple[int | None, int]]] = [[]]
        self.skips: list[list[int]] = [[]]
        at, open_regions = 0, []
        for m in _PART.finditer(template):
            part = m.group()
            if part == "[[":
                open_regions.append(at)
            elif part == "]]":
                self.skips[open_regions.pop()].append(at)
            elif m.group(1):
                least, most = int(m.group(1)), int(m.group(2))
                early = []
                for k in range(most):
                    if k >= least:
                        early.append(at)
                    at = self._step(at, None)
                for s in early:
                    self.skips[s].append(at)
            else:
                at = self._step(at, word_hash(part))
        if open_regions:
            raise ValueError("an optional region is left open")
        self.final = at
        self.closure = [self._close({s}) for s in range(len(self.moves))]
        starts = {h for s in self.closure[0] for h, _ in self.moves[s]}
        if None in starts or self.final in self.closure[0]:
            raise ValueError("a template must begin with a word and have a mandatory one")
        self.starts = starts

    def _step(self, at: int, word: int | None) -> int:
        self.moves.append([])
        self.skips.append([])
        self.moves[at].append((word, len(self.moves) - 1))
        return len(self.moves) - 1

    def _close(self, states: set[int]) -> frozenset[int]:
        todo = list(states)
        while todo:
            for t in self.skips[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return frozenset(states)

    def longest(self, words: np.ndarray, at: int, stop: int) -> int:
        """End of the longest accepted run from ``at``, or -1."""
        states, end = self.closure[0], -1
        while states and at < stop:
            word = int(words[at])
            states = frozenset(c for s in states for w, t in self.moves[s] if w is None or w == word for c in self.closure[t])
            at += 1
            if self.final in states:
                end = at
        return end


def _scan(phrases: dict[str, str], templates: dict[str, str]):
    def run(batches):
        automata = {label: Automaton(t) for label, t in templates.items()}
        wanted = [(np.array([word_hash(w) for w in p.split()], np.uint64), label) for p, label in phrases.items()]
        starts = np.array(sorted({h for a in automata.values() for h in a.starts}), np.uint64)
        for b in batches:
            for part in slices(b, "text"):
                n = part.num_rows
                _, _, row, h = word_hashes(*text_bytes(part.column("text")))
                offs = row_offsets(row, n)
                places: list[list[tuple[int, int, str, bool]]] = [[] for _ in range(n)]
                for words, label in wanted:
                    i = np.flatnonzero(h[: max(0, len(h) - len(words) + 1)] == words[0])
                    for k in range(1, len(words)):
                        i = i[h[i + k] == words[k]]
                    i = i[row[i] == row[i + len(words) - 1]] if len(i) else i
                    for r, p in zip(row[i].tolist(), (i - offs[row[i]]).tolist(), strict=True):
                        places[r].append((p, p + len(words), label, True))
                for i in np.flatnonzero(np.isin(h, starts)).tolist():
                    r = int(row[i])
                    for label, a in automata.items():
                        if int(h[i]) in a.starts and (end := a.longest(h, i, int(offs[r + 1]))) >= 0:
                            places[r].append((i - int(offs[r]), end - int(offs[r]), label, False))
                yield _rows(part, np.diff(offs), places)

    return run


def _rows(part, n_words, places):
    base = [sorted(x for x in p if x[3]) for p in places]
    labels = [sorted({x[2] for x in p}) for p in places]
    columns = {
        "doc_id": part.column("doc_id"), "n_words": pa.array(n_words, pa.int64()),
        "n_base": pa.array([len(x) for x in base], pa.int64()),
        "first_word": pa.array([x[0][0] if x else None for x in base], pa.int64()),
        "last_word": pa.array([x[-1][0] if x else None for x in base], pa.int64()),
        "base_labels": pa.array([",".join(sorted({y[2] for y in x})) for x in base], pa.string()),
        "labels": pa.array([",".join(x) for x in labels], pa.string()),
        "score": pa.array([TEMPLATE_SCORE if any(not y[3] for y in p) else BASE_SCORE if p else 0.0 for p in places], pa.float64()),
        "places": pa.array([[{"label": y[2], "start": y[0], "end": y[1]} for y in sorted(p)] for p in places],
                           pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
    }
    return pa.RecordBatch.from_pydict(columns)


def license_scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places), one row for each document.

    Words are runs of ASCII letters, digits and non-ASCII characters after lower-casing A to Z. ``places`` lists
    every phrase and every accepted template with its first word and the word after its last; the base columns
    tell of phrases only. The score is 1 if a template accepts, 0.5 if only phrases are there, else 0. Null and
    empty texts have no words and no labels; a label found twice is listed once; repeated rows give repeated
    result rows and an empty table none.
    """
    ship(docs.sparkSession)
    rows = narrow(docs, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        _scan(dict(PHRASES if phrases is None else phrases), dict(TEMPLATES if templates is None else templates)),
        f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
        "score double, places array<struct<label: string, start: bigint, end: bigint>>")
