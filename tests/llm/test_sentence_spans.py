"""Repeated runs of sentences against a plain search."""

import hashlib
import re

import numpy as np
import pytest
import xxhash

from panelseq.llm import sentence_spans as S


def split(text):
    parts = re.sub(r"([.!?])[ \t\r\x0b\x0c]", r"\1\n", text or "").split("\n")
    return [x for x in (p.strip(" \t\r\x0b\x0c") for p in parts) if x]


def plain(rows, words, least):
    def key(k):
        h = xxhash.xxh64_intdigest((rows[k][1] or "").encode(), 42)
        return 2**63 - 1 if rows[k][0] is None else rows[k][0], h - (1 << 64) if h >> 63 else h

    seen, gone = {}, {k: set() for k in range(len(rows))}
    for k in sorted(gone, key=key):
        s = split(rows[k][1])
        for p in range(len(s)):
            q = next((q for q in range(p + least, len(s) + 1) if len(re.findall(r"[^ \t\r\n\x0b\x0c]+", " ".join(s[p:q]))) >= words), None)
            if q is not None and seen.setdefault(tuple(s[p:q]), (key(k), p)) != (key(k), p):
                gone[k].update(range(p, q))
    out = []
    for k, (i, t) in enumerate(rows):
        s = split(t)
        left = "\n".join(x for p, x in enumerate(s) if p not in gone[k])
        out.append((i, len(s), len(gone[k]), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(6)
    pool = [" ".join(rng.choice(["on", "of", "élan", "tree", "3.5"], int(rng.integers(1, 5)))) + str(rng.choice([".", "!", "?\n", "\n", ".\r\n", " . "])) for _ in range(60)]
    out = [(k, " ".join(pool[a: a + 9]) + " " + " ".join(rng.choice(pool, 6))) for k, a in enumerate(rng.integers(0, 50, 80).tolist())]
    return out + [(100, None), (101, ""), (102, " \n\t"), (103, "one. two."), (104, "a. b. c. a. b. c. d."), (105, "x. " * 400), (None, out[0][1]), (None, "q. r. s. t."), (106, "q. r. s."), (106, "q. r. s. x. y. z."), (106, "x. y. z."), (3, out[3][1]), (107, "e.g. this v1.2 is. not! cut?yes. ok")]


@pytest.mark.parametrize(("words", "least"), [(1, 1), (1, 3), (5, 1), (12, 2)])
def test_equals_plain_search(spark, rows, words, least):
    df = spark.createDataFrame([(i, t, 1, "h") for i, t in rows], "doc_id long, text string, places int, h string").repartition(4)
    got = S.sentence_dedup(df, words, least).collect()
    assert sorted(((r.doc_id, r.n_sentences, r.n_removed, r.kept_sha256) for r in got), key=str) == plain(rows, words, least)
    texts = dict(rows)
    for r in got:
        if r.doc_id not in (None, 106):
            assert (r.text == (texts[r.doc_id] or "")) if r.n_removed == 0 else len(split(r.text)) <= r.n_sentences - r.n_removed
    assert S.sentence_dedup(df.limit(0), words, least).count() == 0


def test_long_sentences_and_short_texts(spark):
    """A repeated long sentence goes wherever it stands; short repeated lines and short copies stay."""
    long = " ".join(f"w{k}" for k in range(60)) + "."
    rows = [(1, "Alone here. " + long + " More of it."), (2, long), (3, "Other. Text. " + long), (4, "One. two. three."), (5, "One. two. three.")]
    got = {r.doc_id: (r.n_removed, r.text) for r in S.sentence_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (0, rows[0][1]), 2: (1, ""), 3: (1, "Other. Text. "), 4: (0, rows[3][1]), 5: (0, rows[4][1])}
